"""Word lists, used as default parameters of the term counters.

Fixed values: results are only comparable when these lists are the same.
"""

LEGAL = (
    "fcra",
    "fdcpa",
    "cfpb",
    "15 u.s.c",
    "15 usc",
    "fair credit reporting act",
    "truth in lending",
    "equal credit opportunity",
    "violation",
    "statute",
    "pursuant",
    "section",
    "rights",
    "written consent",
    "identity theft",
)
EVIDENCE = (
    "attached",
    "attachment",
    "document",
    "proof",
    "evidence",
    "statement",
    "screenshot",
    "letter",
    "police report",
    "ftc report",
    "affidavit",
)
URGENCY = (
    "urgent",
    "immediately",
    "as soon as possible",
    "asap",
    "please help",
    "cannot",
    "unable",
    "emergency",
    "overdue",
    "late fee",
)
HARDSHIP = (
    "homeless",
    "eviction",
    "rent",
    "job",
    "employment",
    "medical",
    "illness",
    "disability",
    "veteran",
    "servicemember",
    "financial hardship",
    "depressed",
)
TEMPLATE = (
    "in accordance with",
    "federally protected consumer",
    "without my written consent",
    "fair credit reporting act",
    "pursuant to section",
    "under 15 u.s.c",
    "15 u.s.c 1681",
    "15 usc 1681",
    "violation of my rights",
    "doctrine of estoppel",
)
POLITENESS = ("please", "thank you", "appreciate", "kindly")
ANGER = (
    "fraud",
    "illegal",
    "deceptive",
    "abusive",
    "unfair",
    "lie",
    "lying",
    "refuse",
    "denied",
    "harass",
)

# Measure name -> word list, in output order.
LEXICONS = {
    "legal_term_count": LEGAL,
    "evidence_term_count": EVIDENCE,
    "urgency_term_count": URGENCY,
    "hardship_term_count": HARDSHIP,
    "template_phrase_count": TEMPLATE,
    "politeness_count": POLITENESS,
    "anger_term_count": ANGER,
}

# Words that join clauses and order a narrative; counted as whole words.
CONNECTIVES = (
    "additionally",
    "afterwards",
    "also",
    "although",
    "because",
    "but",
    "consequently",
    "finally",
    "first",
    "firstly",
    "furthermore",
    "hence",
    "however",
    "if",
    "instead",
    "lastly",
    "meanwhile",
    "moreover",
    "nevertheless",
    "next",
    "otherwise",
    "second",
    "secondly",
    "since",
    "so",
    "subsequently",
    "then",
    "therefore",
    "though",
    "thus",
    "unless",
    "while",
)

# English stop words: Spark's list, without the entries (short words, words with
# an apostrophe) that a topic word can never equal.
ENGLISH_STOP_WORDS = tuple(
    """
    myself our ours ourselves you your yours yourself yourselves him his himself she her
    hers herself its itself they them their theirs themselves what which who whom this that
    these those are was were been being have has had having does did doing the and but
    because until while for with about against between into through during before after
    above below from down out off over under again further then once here there when where
    why how all any both each few more most other some such nor not only own same than too
    very can will just don should now cannot could ought would
    """.split()
)

# Words dropped by the topic and model vocabularies besides the English list.
DOMAIN_STOP_WORDS = (
    "xx",
    "xxx",
    "xxxx",
    "xxxxx",
    "xxxxxx",
    "xxxxxxx",
    "xxxxxxxx",
    "xxxxxxxxx",
    "xxxxxxxxxx",
    "00",
    "000",
    "0000",
    "2020",
    "2021",
    "2022",
    "2023",
    "2024",
    "2025",
    "account",
    "accounts",
    "consumer",
    "complaint",
    "company",
    "credit",
)
