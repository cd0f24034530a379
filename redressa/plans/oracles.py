"""The same answers as ANSI-style SQL for DuckDB, written apart from the operators.

Each text builds on the shared ``WITH`` steps below: raw rows, first row per
id, cleaned fields, text measures, modeling rows. DuckDB skips unused steps.
"""

from __future__ import annotations

from collections.abc import Iterable

from redressa.functions.fields import NA_TOKENS
from redressa.functions.lexicons import CONNECTIVES, DOMAIN_STOP_WORDS, ENGLISH_STOP_WORDS, LEXICONS
from redressa.functions.text import BLANKS, CHARACTER_MEASURES, SHAPE_MEASURES
from redressa.operators.profile import NUMERIC_FEATURES, PERIOD_MEASURES

CUTOFF = "TIMESTAMP '1998-06-01'"


def _quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_BLANKS = "'" + BLANKS + "'"

RAW = f"""
narr AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS complaint_id, doc_id AS ingest_seq, source AS raw_source,
    CASE WHEN doc_id % 31 = 0 THEN NULL
         WHEN doc_id % 29 = 0 THEN '   '
         ELSE text || CASE doc_id % 8
           WHEN 0 THEN ' Pursuant to section 15 U.S.C 1681 this is a violation of my rights.'
           WHEN 1 THEN ' Please help, XXXX charged {{$1,200.50}} on XX/XX/2022!'
           WHEN 2 THEN ' See the attached police report and letter; they refuse?'
           WHEN 3 THEN ' I lost my job and cannot pay rent. Thank you.'
           ELSE '' END
    END AS consumer_narrative
  FROM documents),
both_sources AS (
  SELECT * FROM narr
  UNION ALL
  SELECT n.doc_id, n.complaint_id, n.ingest_seq + 1000000000, 'replay',
    'COPY ' || coalesce(n.consumer_narrative, '')
  FROM narr n WHERE n.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
sent AS (
  SELECT l_orderkey AS doc_id, min(l_shipdate) AS sent FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT b.doc_id, b.ingest_seq, b.complaint_id, b.raw_source, b.consumer_narrative,
    o.o_orderdate AS date_received, s.sent AS date_sent_to_company,
    CASE b.doc_id % 12
      WHEN 0 THEN 'Debt collection' WHEN 1 THEN 'Credit card or prepaid card'
      WHEN 2 THEN 'Checking or savings account' WHEN 3 THEN 'Mortgage'
      WHEN 4 THEN 'Student loan' WHEN 5 THEN 'Vehicle loan or lease'
      WHEN 6 THEN 'Payday loan, title loan, or personal loan'
      WHEN 7 THEN 'Money transfer, virtual currency, or money service'
      WHEN 8 THEN 'Debt or credit management' WHEN 9 THEN NULL
      ELSE 'Credit reporting, credit repair services, or other personal consumer reports'
    END AS product,
    CASE WHEN b.doc_id % 17 <> 0 THEN p.p_type END AS issue, p.p_brand AS sub_issue,
    su.s_name AS company, CASE WHEN b.doc_id % 13 <> 0 THEN n.n_name END AS state,
    CASE b.doc_id % 3 WHEN 0 THEN 'Web' WHEN 1 THEN 'Phone' ELSE 'Referral' END AS submitted_via,
    CASE (b.doc_id * 7 + o.o_custkey) % 10
      WHEN 0 THEN 'Closed with monetary relief'
      WHEN 1 THEN 'Closed with non-monetary relief' WHEN 2 THEN 'Closed with non-monetary relief'
      WHEN 8 THEN 'In progress' WHEN 9 THEN NULL
      ELSE CASE WHEN o.o_custkey IS NOT NULL THEN 'Closed with explanation' END
    END AS company_response,
    CASE l.quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS timely_response,
    CASE l.toxic WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS consumer_disputed
  FROM both_sources b
  LEFT JOIN orders o ON o.o_orderkey = b.doc_id
  LEFT JOIN part p ON p.p_partkey = b.doc_id
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN supplier su ON su.s_suppkey = o.o_custkey % 10
  LEFT JOIN labels l ON l.doc_id = b.doc_id
  LEFT JOIN sent s ON s.doc_id = b.doc_id),
dedup AS (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY ingest_seq) = 1)
"""


def _yes_no(column: str) -> str:
    v = f"lower(trim({column}, {_BLANKS}))"
    return (
        f"CASE WHEN {v} IN ('yes', 'y', 'true', '1') THEN 1.0::DOUBLE "
        f"WHEN {v} IN ('no', 'n', 'false', '0') THEN 0.0::DOUBLE END"
    )


CLEAN = f"""
clean0 AS (
  SELECT * REPLACE (coalesce(consumer_narrative, '') AS consumer_narrative),
    lower(coalesce(product, '')) AS p, lower(coalesce(company_response, '')) AS r,
    CAST(trim(coalesce(consumer_narrative, ''), {_BLANKS}) <> '' AS INTEGER) AS has_narrative
  FROM dedup),
clean AS (
  SELECT *,
    CASE WHEN contains(p, 'money transfer') OR contains(p, 'virtual currency') THEN 'Money transfer'
         WHEN contains(p, 'payday') OR contains(p, 'personal loan') OR contains(p, 'consumer loan')
           THEN 'Consumer loan'
         WHEN contains(p, 'vehicle loan') OR contains(p, 'lease') THEN 'Vehicle loan/lease'
         WHEN contains(p, 'student loan') THEN 'Student loan'
         WHEN contains(p, 'mortgage') THEN 'Mortgage'
         WHEN contains(p, 'checking') OR contains(p, 'savings') OR contains(p, 'bank account')
           THEN 'Bank account'
         WHEN contains(p, 'credit card') OR contains(p, 'prepaid') THEN 'Credit card/prepaid'
         WHEN contains(p, 'debt collection') THEN 'Debt collection'
         WHEN contains(p, 'credit reporting') OR contains(p, 'consumer reports')
           THEN 'Credit reporting'
         ELSE 'Other' END AS product_group,
    {_yes_no('timely_response')} AS timely_binary,
    {_yes_no('consumer_disputed')} AS consumer_disputed_binary,
    CAST(floor((epoch_us(date_sent_to_company) - epoch_us(date_received)) / 86400000000.0::DOUBLE)
      AS BIGINT) AS days_to_company,
    CAST(year(date_received) AS INTEGER) AS complaint_year,
    strftime(date_received, '%Y-%m') AS complaint_month,
    year(date_received) || 'Q' || quarter(date_received) AS complaint_quarter,
    CAST(coalesce(date_received >= {CUTOFF}, FALSE) AS INTEGER) AS post_cutoff,
    CASE WHEN contains(r, 'non-monetary relief') THEN 'non_monetary_relief'
         WHEN contains(r, 'monetary relief') THEN 'monetary_relief'
         WHEN contains(r, 'explanation') THEN 'explanation' ELSE 'other' END AS response_outcome,
    CAST(contains(r, 'monetary relief') AND NOT contains(r, 'non-monetary relief') AS INTEGER)
      AS monetary_relief,
    CAST(contains(r, 'non-monetary relief') AS INTEGER) AS non_monetary_relief,
    CAST(contains(r, 'monetary relief') AS INTEGER) AS any_relief,
    CAST(contains(r, 'explanation') AS INTEGER) AS closed_with_explanation,
    CAST(contains(r, 'closed') AS INTEGER) AS closed_response
  FROM clean0),
modeling0 AS (
  SELECT * FROM clean
  WHERE has_narrative = 1 AND date_received IS NOT NULL AND company_response IS NOT NULL)
"""


def _hits(column: str, terms: Iterable[str]) -> str:
    parts = []
    for term in terms:
        q = term.replace("'", "''")
        parts.append(f"(length({column}) - length(replace({column}, '{q}', ''))) // {len(term)}")
    return "CAST(" + " + ".join(parts) + " AS INTEGER)"


def _measures(source: str, name: str) -> str:
    """Steps that add the text measures to ``source`` under ``name``."""
    lexicon = ",\n    ".join(f"{_hits('low', terms)} AS {m}" for m, terms in LEXICONS.items())
    return rf"""
{name}_w AS (
  SELECT *, regexp_extract_all(low, '[A-Za-z]+(?:''[A-Za-z]+)?|\p{{Nd}}+(?:\.\p{{Nd}}+)?') AS words
  FROM (SELECT *, consumer_narrative AS t, lower(consumer_narrative) AS low FROM {source})),
{name}_c AS (
  SELECT *, CAST(len(words) AS INTEGER) AS n_words,
    list_filter(words, lambda w: regexp_full_match(w, '[a-z]+')) AS plain,
    CAST(CASE WHEN t = '' THEN 0
      ELSE greatest(1, len(regexp_extract_all(t, '[.!?]+'))) END AS INTEGER) AS n_sentences,
    len(regexp_extract_all(t, '[A-Z]')) AS upper_letters,
    len(regexp_extract_all(t, '[A-Za-z]')) AS letters
  FROM {name}_w),
{name} AS (
  SELECT * EXCLUDE (words, plain, upper_letters, letters),
    CAST(length(t) AS INTEGER) AS n_chars,
    CASE WHEN len(plain) = 0 THEN 0.0 ELSE
      CAST(list_sum(list_transform(plain, lambda w: length(w))) AS DOUBLE) / len(plain)
      END AS avg_word_len,
    CASE WHEN n_sentences = 0 THEN 0.0 ELSE CAST(n_words AS DOUBLE) / n_sentences END
      AS avg_sentence_len,
    CASE WHEN n_words = 0 THEN 0.0 ELSE CAST(len(list_distinct(words)) AS DOUBLE) / n_words END
      AS lexical_diversity,
    CASE WHEN letters = 0 THEN 0.0 ELSE CAST(upper_letters AS DOUBLE) / letters END
      AS uppercase_ratio,
    CAST(len(regexp_extract_all(t, '\p{{Nd}}')) AS INTEGER) AS digit_count,
    CAST(len(regexp_extract_all(t, '\{{\$[0-9,]+(?:\.[0-9]+)?\}}|\$[0-9,]+')) AS INTEGER)
      AS money_amount_count,
    CAST(len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'),
      lambda w: regexp_full_match(w, 'X{{2,}}'))) AS INTEGER) AS redaction_count,
    CAST(length(t) - length(replace(t, '?', '')) AS INTEGER) AS question_count,
    CAST(length(t) - length(replace(t, '!', '')) AS INTEGER) AS exclamation_count,
    {lexicon},
    CAST(len(list_filter(words, lambda w: w IN ({_quoted(CONNECTIVES)}))) AS INTEGER) AS connective_count,
    CAST(len(list_filter(string_split(replace(t, chr(13), chr(10)), chr(10)),
      lambda line: trim(line, ' ' || chr(9)) <> '')) AS INTEGER) AS n_paragraphs
  FROM {name}_c)
"""


BASE = f"{RAW}, {CLEAN}, {_measures('modeling0', 'modeling')}"
STOP_WORDS = _quoted(sorted({*ENGLISH_STOP_WORDS, *DOMAIN_STOP_WORDS}))
DOCS = "docs AS (SELECT complaint_id, coalesce(consumer_narrative, '') AS consumer_narrative FROM narr)"
VOCABULARY = rf"""
kept AS (
  SELECT complaint_id, list_filter(
    regexp_extract_all(lower(consumer_narrative), '[\p{{L}}\p{{N}}_]+'),
    lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({STOP_WORDS})) AS w
  FROM docs),
terms AS (
  SELECT complaint_id, unnest(w) AS term FROM kept
  UNION ALL
  SELECT complaint_id, unnest(list_transform(
    list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS term
  FROM kept WHERE len(w) >= 2),
doc_terms AS (SELECT complaint_id, term, count(*) AS tf FROM terms GROUP BY ALL),
term_counts AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM doc_terms GROUP BY term),
n_docs AS (SELECT count(*) AS n FROM docs),
chosen AS (
  SELECT term, cf, df, ln((n + 1)::DOUBLE / (df + 1)) + 1.0 AS idf
  FROM term_counts, n_docs WHERE df >= 5 AND df <= 0.9 * n
  ORDER BY cf DESC, term LIMIT 8000)
"""
WORDS = f"{DOCS}, {VOCABULARY}"


def _sql(steps: str, select: str) -> str:
    """A query on the steps; ``select`` may open with further steps (', name AS ...')."""
    return f"WITH {steps.strip()}\n{select.strip()}"


def _avg(column: str, name: str) -> str:
    return f"round(avg(CAST({column} AS DOUBLE)), 6) AS {name}"


RELIEF = ", ".join(
    [
        _avg("any_relief", "any_relief_rate"),
        _avg("monetary_relief", "monetary_relief_rate"),
        _avg("non_monetary_relief", "non_monetary_relief_rate"),
        _avg("timely_binary", "timely_rate"),
        _avg("n_words", "mean_words"),
    ]
)

ORACLES: dict[str, str] = {}

# --- sources ---------------------------------------------------------------
ORACLES["raw_complaints"] = _sql(
    RAW,
    """SELECT ingest_seq, complaint_id, raw_source,
  strftime(date_received, '%Y-%m-%d %H:%M:%S') AS date_received,
  strftime(date_sent_to_company, '%Y-%m-%d %H:%M:%S') AS date_sent_to_company,
  product, issue, sub_issue, consumer_narrative, company, state, submitted_via,
  company_response, timely_response, consumer_disputed
FROM raw""",
)
ORACLES["recent_complaints"] = _sql(
    RAW,
    f"""SELECT complaint_id, strftime(date_received, '%Y-%m-%d %H:%M:%S') AS date_received, raw_source
FROM (SELECT * FROM raw
  WHERE raw_source <> 'replay' AND date_received BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'
    AND trim(coalesce(consumer_narrative, ''), {_BLANKS}) <> ''
  ORDER BY raw.date_received DESC, complaint_id LIMIT 500)""",
)
ORACLES["source_union"] = """
SELECT 'documents' AS raw_source, CAST(doc_id AS VARCHAR) AS complaint_id,
  text AS consumer_narrative, CAST(NULL AS VARCHAR) AS complaint_what_happened,
  lang, CAST(NULL AS VARCHAR) AS role
FROM documents
UNION ALL
SELECT 'conversations', conv_id || '-' || turn, NULL, text, NULL, role FROM conversations"""
ORACLES["source_manifest"] = _sql(
    RAW,
    """SELECT raw_source, count(*) AS rows FROM both_sources GROUP BY raw_source
UNION ALL SELECT 'all sources', count(*) FROM both_sources""",
)
ORACLES["na_tokens"] = f"""
SELECT doc_id, CASE WHEN v NOT IN ({_quoted(NA_TOKENS)}) THEN v END AS value
FROM (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'N/A' WHEN 1 THEN 'None' WHEN 2 THEN ''
  WHEN 3 THEN 'nan' WHEN 4 THEN 'NULL' WHEN 5 THEN '#N/A' WHEN 6 THEN 'none' WHEN 7 THEN 'N/A '
  ELSE source END AS v FROM documents)"""

ORACLES["csv_scan"] = _sql(
    RAW,
    """SELECT complaint_id, consumer_narrative,
  CASE WHEN doc_id % 5 <> 0 THEN raw_source END AS state FROM narr""",
)
ORACLES["csv_blocks"] = ORACLES["csv_scan"]
ORACLES["api_hits"] = """
SELECT CAST(doc_id AS VARCHAR) AS complaint_id, lang AS state, text FROM documents"""

_MIXED = """
SELECT CAST(doc_id AS VARCHAR) AS complaint_id,
  CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN source END
    ELSE source END AS state,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS product,
  CASE WHEN doc_id % 2 = 1 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN lang END AS issue
FROM documents"""
ORACLES["csv_mixed_headers"] = _MIXED
ORACLES["parquet_mixed_columns"] = _MIXED

# --- cleaning --------------------------------------------------------------
ORACLES["alias_coalesce"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS complaint_id,
  coalesce(CASE WHEN quality = 1 THEN text END, 'short ' || source) AS consumer_narrative,
  CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'Yes' END AS timely_response,
  source AS zip_code, CASE WHEN toxic = 0 THEN lang ELSE source END AS state,
  CAST(NULL AS VARCHAR) AS company
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
ORACLES["parse_dates"] = """
SELECT o_orderkey, strftime(CASE
  WHEN o_orderkey % 13 IN (0, 1, 4, 6, 8, 9) THEN date_trunc('day', o_orderdate)
  WHEN o_orderkey % 13 = 2 THEN date_trunc('second', o_orderdate)
  WHEN o_orderkey % 13 = 3 THEN date_trunc('second', o_orderdate) - INTERVAL 2 HOUR
  WHEN o_orderkey % 13 = 7 THEN date_trunc('day', o_orderdate) + INTERVAL 1335 MINUTE
  WHEN o_orderkey % 13 = 10 THEN date_trunc('day', o_orderdate) + INTERVAL 3723 SECOND
  WHEN o_orderkey % 13 = 11 THEN date_trunc('month', o_orderdate)
  END, '%Y-%m-%d %H:%M:%S') AS parsed
FROM orders"""
ORACLES["parse_binary"] = f"""
SELECT event_id, {_yes_no('v')} AS flag
FROM (SELECT event_id, CASE event_id % 12 WHEN 0 THEN ' YES ' WHEN 1 THEN 'y' WHEN 2 THEN 'True'
  WHEN 3 THEN '1' WHEN 4 THEN 'no' WHEN 5 THEN 'N' || chr(9) WHEN 6 THEN 'FALSE' WHEN 7 THEN '0'
  WHEN 8 THEN '2' WHEN 9 THEN '' ELSE event_type END AS v FROM events)"""
ORACLES["dedup_first"] = _sql(
    RAW, "SELECT complaint_id, ingest_seq, raw_source, consumer_narrative FROM dedup"
)
ORACLES["has_narrative"] = _sql(
    RAW,
    f"""SELECT ingest_seq,
  CAST(trim(coalesce(consumer_narrative, ''), {_BLANKS}) <> '' AS INTEGER) AS has_narrative
FROM both_sources""",
)
_CLEAN = f"{RAW}, {CLEAN}"
ORACLES["product_group"] = _sql(_CLEAN, "SELECT complaint_id, product, product_group FROM clean")
ORACLES["sink_round_trip"] = _sql(
    _CLEAN,
    """SELECT fmt, complaint_id, product_group, complaint_year, response_outcome
FROM clean, (VALUES ('parquet'), ('csv'), ('json')) formats(fmt)""",
)
ORACLES["source_copy"] = "SELECT doc_id, source FROM documents"
ORACLES["response_outcome"] = _sql(
    _CLEAN,
    """SELECT complaint_id, company_response, response_outcome, monetary_relief,
  non_monetary_relief, any_relief, closed_with_explanation, closed_response FROM clean""",
)
ORACLES["days_to_company"] = _sql(_CLEAN, "SELECT complaint_id, days_to_company FROM clean")
ORACLES["calendar_keys"] = _sql(
    _CLEAN,
    """SELECT complaint_id, complaint_year, complaint_month, complaint_quarter, post_cutoff
FROM clean""",
)
ORACLES["modeling_rows"] = _sql(
    _CLEAN,
    "SELECT complaint_id, complaint_month, product_group, response_outcome FROM modeling0",
)
ORACLES["cleaning_audit"] = _sql(
    _CLEAN,
    """SELECT (SELECT count(*) FROM raw) AS raw_rows,
  (SELECT count(*) FROM dedup) AS deduplicated_rows, count(*) AS modeling_rows,
  strftime(min(date_received), '%Y-%m-%d') AS date_min,
  strftime(max(date_received), '%Y-%m-%d') AS date_max
FROM modeling0""",
)
_DICTIONARY = {
    "post_cutoff": "1 when received on the cutoff day or later.",
    "any_relief": "1 for a monetary or a non-monetary relief response.",
    "monetary_relief": "1 for a response closed with monetary relief.",
    "non_monetary_relief": "1 for a response closed with non-monetary relief.",
    "timely_binary": "1 when the company response is marked as timely.",
    "n_words": "Words and numbers in the narrative.",
    "avg_sentence_len": "Words per sentence.",
    "lexical_diversity": "Distinct words over all words.",
    "legal_term_count": "Hits of legal and regulatory terms.",
    "evidence_term_count": "Hits of evidence and document terms.",
    "urgency_term_count": "Hits of urgency terms.",
    "hardship_term_count": "Hits of hardship terms.",
    "template_phrase_count": "Hits of repeated legal phrases.",
    "product_group": "Coarse product class used by the models.",
}
ORACLES["feature_dictionary"] = _sql(
    BASE,
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS variable, '{note}' AS definition, count({name}) AS rows_with_value "
        "FROM modeling"
        for name, note in _DICTIONARY.items()
    ),
)

# --- text measures ---------------------------------------------------------
_DOC_MEASURES = f"{RAW}, {DOCS}, {_measures('docs', 'm')}"


def _listed(names: Iterable[str], doubles: Iterable[str]) -> str:
    doubles = set(doubles)
    return ", ".join(f"round({n}, 6) AS {n}" if n in doubles else n for n in names)


_RATIOS = ("avg_word_len", "avg_sentence_len", "lexical_diversity", "uppercase_ratio")
ORACLES["text_tokens"] = _sql(
    _DOC_MEASURES,
    """SELECT complaint_id, CAST(unnest(range(len(words))) AS INTEGER) AS position,
  unnest(words) AS token FROM m_w""",
)
ORACLES["text_shape"] = _sql(
    _DOC_MEASURES, f"SELECT complaint_id, {_listed(SHAPE_MEASURES, _RATIOS)} FROM m"
)
ORACLES["text_chars"] = _sql(
    _DOC_MEASURES, f"SELECT complaint_id, {_listed(CHARACTER_MEASURES, _RATIOS)} FROM m"
)
ORACLES["text_structure"] = _sql(_DOC_MEASURES, "SELECT complaint_id, connective_count, n_paragraphs FROM m")
ORACLES["lexicon_counts"] = _sql(
    _DOC_MEASURES, f"SELECT complaint_id, {', '.join(LEXICONS)} FROM m"
)

# --- profile ---------------------------------------------------------------
ORACLES["dataset_profile"] = _sql(
    BASE,
    f"""SELECT count(*) AS rows, strftime(min(date_received), '%Y-%m-%d') AS date_min,
  strftime(max(date_received), '%Y-%m-%d') AS date_max,
  {_avg('post_cutoff', 'post_cutoff_share')}, {_avg('any_relief', 'any_relief_rate')},
  {_avg('monetary_relief', 'monetary_relief_rate')},
  {_avg('non_monetary_relief', 'non_monetary_relief_rate')},
  {_avg('timely_binary', 'timely_response_rate')},
  CAST(median(n_words) AS DOUBLE) AS median_words, {_avg('n_words', 'mean_words')},
  count(DISTINCT product) AS unique_products, count(DISTINCT issue) AS unique_issues,
  count(DISTINCT company) AS unique_companies, count(DISTINCT state) AS unique_states,
  CAST(53 AS BIGINT) AS columns
FROM modeling""",
)
for _name, _column in (
    ("freq_product_group", "product_group"),
    ("freq_product", "product"),
    ("freq_issue", "issue"),
    ("freq_company", "company"),
    ("freq_state", "state"),
    ("freq_outcome", "response_outcome"),
):
    ORACLES[_name] = _sql(
        _CLEAN,
        f"""SELECT coalesce({_column}, 'Missing') AS {_column}, count(*) AS n,
  round(count(*)::DOUBLE / (SELECT count(*) FROM modeling0), 6) AS share
FROM modeling0 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50""",
    )
ORACLES["monthly_profile"] = _sql(
    BASE,
    f"""SELECT complaint_month, count(*) AS n, {RELIEF},
  {_avg('template_phrase_count', 'template_phrase_rate')}
FROM modeling GROUP BY complaint_month""",
)
ORACLES["product_response"] = _sql(
    BASE,
    f"""SELECT product_group, count(*) AS n, {RELIEF},
  {_avg('legal_term_count', 'legal_terms')}, {_avg('template_phrase_count', 'template_phrases')}
FROM modeling GROUP BY product_group""",
)
ORACLES["issue_response"] = _sql(
    BASE,
    f"""SELECT issue, count(*) AS n, {_avg('any_relief', 'any_relief_rate')},
  {_avg('timely_binary', 'timely_rate')}, {_avg('n_words', 'mean_words')},
  {_avg('template_phrase_count', 'template_phrases')}
FROM modeling WHERE issue IS NOT NULL GROUP BY issue HAVING count(*) >= 50
ORDER BY n DESC, issue LIMIT 50""",
)
ORACLES["pre_post_summary"] = _sql(
    BASE,
    f"""SELECT post_cutoff, {', '.join(_avg(m, m) for m in PERIOD_MEASURES)},
  CASE WHEN post_cutoff = 1 THEN 'after' ELSE 'before' END AS period
FROM modeling GROUP BY post_cutoff""",
)
ORACLES["feature_correlation"] = _sql(
    BASE,
    "\nUNION ALL ".join(
        f"""SELECT '{f}' AS feature, CASE WHEN stddev_pop({f}) > 0 AND stddev_pop(any_relief) > 0
  THEN round(corr({f}, any_relief), 6) END AS correlation FROM modeling"""
        for f in NUMERIC_FEATURES
    ),
)

# --- topics ----------------------------------------------------------------
_WORDS = f"{RAW}, {WORDS}"
ORACLES["topic_tokens"] = _sql(
    _WORDS,
    """SELECT complaint_id, CAST(unnest(range(len(w))) AS INTEGER) AS position,
  unnest(w) AS token FROM kept""",
)
ORACLES["ngram_counts"] = _sql(_WORDS, "SELECT term, cf, df FROM term_counts")
ORACLES["vocabulary"] = _sql(
    _WORDS,
    """SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, cf, df,
  round(idf, 6) AS idf FROM chosen""",
)
ORACLES["tfidf_weights"] = _sql(
    _WORDS,
    """SELECT complaint_id, term,
  round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY complaint_id)), 6) AS weight
FROM doc_terms JOIN chosen USING (term)""",
)
ORACLES["topic_profile"] = _sql(
    BASE,
    f"""SELECT sub_issue AS topic, count(*) AS n, {RELIEF},
  {_avg('template_phrase_count', 'template_phrases')},
  round(count(*)::DOUBLE / (SELECT count(*) FROM modeling WHERE sub_issue IS NOT NULL), 6) AS share
FROM modeling WHERE sub_issue IS NOT NULL GROUP BY 1""",
)

ORACLES["topic_keywords_given"] = _sql(
    _WORDS,
    """, uses AS (
  SELECT n.raw_source, t.term, count(*) AS weight
  FROM terms t JOIN narr n USING (complaint_id) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY raw_source ORDER BY weight DESC, term) AS r FROM uses)
SELECT raw_source, string_agg(term, ', ' ORDER BY r) AS keywords, max(weight) AS top_weight
FROM ranked WHERE r <= 15 GROUP BY raw_source""",
)
ORACLES["dominant_topic_given"] = _sql(
    BASE,
    f""", listed AS (
  SELECT complaint_id, [{', '.join(f'{m}::DOUBLE / greatest(n_words, 1)' for m in LEXICONS)}] AS w
  FROM modeling)
SELECT complaint_id, CAST(list_position(w, list_max(w)) - 1 AS INTEGER) AS dominant_topic,
  round(list_max(w), 6) AS dominant_topic_weight
FROM listed""",
)

# --- models ----------------------------------------------------------------
ORACLES["class_counts"] = _sql(
    _CLEAN,
    """, counted AS (
  SELECT 'any_relief' AS target, any_relief AS class, count(*) AS n FROM modeling0 GROUP BY 2
  UNION ALL
  SELECT 'timely_binary', CAST(timely_binary AS INTEGER), count(*) FROM modeling0
  WHERE timely_binary IS NOT NULL GROUP BY 2)
SELECT target, class, n, CASE WHEN count(*) OVER (PARTITION BY target) >= 2
  AND min(n) OVER (PARTITION BY target) >= 30 THEN 'fit' ELSE 'skipped' END AS status
FROM counted""",
)
ORACLES["class_gate_many"] = """
WITH counted AS (
  SELECT 'one' AS target, 1 AS class, count(*) AS n FROM documents
  UNION ALL SELECT 'two', CAST(doc_id % 2 AS INTEGER), count(*) FROM documents GROUP BY 2
  UNION ALL SELECT 'ten', CAST(doc_id % 10 AS INTEGER), count(*) FROM documents GROUP BY 2)
SELECT *, CASE WHEN count(*) OVER t > 2 THEN 'not binary'
  WHEN count(*) OVER t = 2 AND min(n) OVER t >= 5 THEN 'fit' ELSE 'skipped' END AS status
FROM counted WINDOW t AS (PARTITION BY target)"""
_FILLED = ", ".join(
    [f"coalesce({c}, 'Missing') AS {c}" for c in ("product_group", "submitted_via", "state")]
)
ORACLES["model_inputs"] = _sql(
    BASE,
    f"""SELECT complaint_id, {_FILLED},
  {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in NUMERIC_FEATURES)}
FROM modeling""",
)
_SPLIT = """, sizes AS (
  SELECT any_relief, n, n * (total - ceil(total * 0.25::DOUBLE)) / total AS exact,
    total - ceil(total * 0.25::DOUBLE) AS n_train
  FROM (SELECT any_relief, count(*)::DOUBLE AS n, (SELECT count(*) FROM modeling0)::DOUBLE AS total
    FROM modeling0 GROUP BY any_relief)),
quotas AS (
  SELECT any_relief, n - floor(exact) - CASE WHEN
    row_number() OVER (ORDER BY exact - floor(exact) DESC, any_relief)
      <= n_train - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota
  FROM sizes),
parted AS (
  SELECT m.complaint_id, m.any_relief, CASE WHEN row_number() OVER (
      PARTITION BY m.any_relief ORDER BY md5('42|' || m.complaint_id), m.complaint_id)
    <= q.quota THEN 'test' ELSE 'train' END AS part
  FROM modeling0 m JOIN quotas q ON q.any_relief = m.any_relief)"""
ORACLES["stratified_split"] = _sql(_CLEAN, f"{_SPLIT} SELECT complaint_id, any_relief, part FROM parted")


def _fold(k: int) -> str:
    return f"CAST(('0x' || substr(md5('42|' || complaint_id), 1, 7))::BIGINT % {k} AS INTEGER)"


ORACLES["rare_levels"] = _sql(
    _CLEAN,
    f""", train AS (SELECT {_FILLED} FROM modeling0 WHERE {_fold(4)} <> 0),
levels AS (
  SELECT 'product_group' AS variable, product_group AS level FROM train
  UNION ALL SELECT 'submitted_via', submitted_via FROM train
  UNION ALL SELECT 'state', state FROM train)
SELECT variable, level, count(*) AS n,
  CASE WHEN count(*) >= 30 THEN level ELSE 'infrequent' END AS encoded
FROM levels GROUP BY variable, level""",
)
ORACLES["scaled_features"] = _sql(
    BASE,
    f""", sds AS (SELECT {', '.join(f'stddev_pop({c}) AS {c}_sd' for c in NUMERIC_FEATURES)}
  FROM modeling WHERE {_fold(4)} <> 0)
SELECT complaint_id, {', '.join(
    f'round({c} / CASE WHEN {c}_sd > 0 THEN {c}_sd ELSE 1.0 END, 6) AS {c}'
    for c in NUMERIC_FEATURES)}
FROM modeling, sds""",
)
ORACLES["class_weights"] = _sql(
    _CLEAN,
    """SELECT any_relief AS class, count(*) AS n,
  round((SELECT count(*) FROM modeling0)::DOUBLE / (2 * count(*)), 6) AS weight
FROM modeling0 GROUP BY any_relief""",
)
_SCORED = f"""{BASE}, scored AS (
  SELECT complaint_id, any_relief AS label,
    CAST(legal_term_count + evidence_term_count + 1 AS DOUBLE)
      / (legal_term_count + evidence_term_count + anger_term_count + hardship_term_count
         + n_sentences + 2) AS score
  FROM modeling)"""
_CONFUSION = f"""{_SCORED}, confusion AS (
  SELECT count(*) FILTER (score >= 0.3 AND label = 1)::DOUBLE AS tp,
    count(*) FILTER (score >= 0.3 AND label = 0)::DOUBLE AS fp,
    count(*) FILTER (score < 0.3 AND label = 1)::DOUBLE AS fn,
    count(*) FILTER (score < 0.3 AND label = 0)::DOUBLE AS tn
  FROM scored),
per_class AS (
  SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p,
    coalesce(tn / nullif(tn + fp, 0), 0) AS r, tn + fp AS s FROM confusion
  UNION ALL
  SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), tp + fn
  FROM confusion),
report AS (SELECT class, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, s FROM per_class)"""
ORACLES["binary_metrics"] = _sql(
    _CONFUSION,
    """SELECT CAST(tp + fp + fn + tn AS BIGINT) AS n_rows,
  round((tp + fn) / (tp + fp + fn + tn), 6) AS positive_rate,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round((SELECT avg(r) FROM report), 6) AS balanced_accuracy,
  round((SELECT f FROM report WHERE class = '1'), 6) AS f1
FROM confusion""",
)
ORACLES["class_report"] = _sql(
    _CONFUSION,
    """SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
  CAST(s AS BIGINT) AS support FROM report
UNION ALL
SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT)
FROM report
UNION ALL
SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6),
  round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT)
FROM report""",
)
_STEPS = """, steps AS (
  SELECT score, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label = 0)::DOUBLE AS neg
  FROM scored GROUP BY score)"""
ORACLES["roc_auc"] = _sql(
    _SCORED + _STEPS,
    """SELECT round(sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc
FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY score) AS below FROM steps)""",
)
ORACLES["average_precision"] = _sql(
    _SCORED + _STEPS,
    """SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision
FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp
  FROM steps)""",
)
ORACLES["calibration"] = _sql(
    _SCORED,
    """SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n,
  round(avg(score), 6) AS mean_score, round(avg(label::DOUBLE), 6) AS positive_rate
FROM scored GROUP BY 1""",
)

# The best rising rates: at a score, the largest over its stretches' starts of the least mean up to an end.
_RISING = """, cumulated AS (
  SELECT score, count(*) AS n, sum(label) AS pos, sum(count(*)) OVER w AS n_upto, sum(sum(label)) OVER w AS pos_upto
  FROM {rows} GROUP BY score WINDOW w AS (ORDER BY score)),
stretches AS (
  SELECT a.score AS start, b.score AS score, min((b.pos_upto - a.pos_upto + a.pos)::DOUBLE
    / (b.n_upto - a.n_upto + a.n)) OVER (PARTITION BY a.score ORDER BY b.score DESC) AS least
  FROM cumulated a JOIN cumulated b ON a.score <= b.score),
rising AS (SELECT score, max(least) AS rate FROM stretches GROUP BY score)"""
ORACLES["isotonic_blocks"] = _sql(
    _SCORED + _RISING.format(rows="scored"),
    """SELECT min(score) AS first, max(score) AS last, CAST(sum(n) AS BIGINT) AS n,
  CAST(sum(pos) AS BIGINT) AS positives, rate
FROM rising JOIN cumulated USING (score) GROUP BY rate""",
)

# --- shift -----------------------------------------------------------------
ORACLES["yearly_counts"] = _sql(
    _CLEAN, "SELECT complaint_year, count(*) AS n FROM modeling0 GROUP BY complaint_year"
)
ORACLES["period_share"] = _sql(
    _CLEAN,
    """, halves AS (
  SELECT count(*) FILTER (post_cutoff = 0) AS n_before, count(*) FILTER (post_cutoff = 1) AS n_after,
    avg(any_relief::DOUBLE) FILTER (post_cutoff = 0) AS b,
    avg(any_relief::DOUBLE) FILTER (post_cutoff = 1) AS a
  FROM modeling0)
SELECT n_before, n_after, round(n_before::DOUBLE / (n_before + n_after), 6) AS share_before,
  round(n_after::DOUBLE / (n_before + n_after), 6) AS share_after,
  round(b, 6) AS rate_before, round(a, 6) AS rate_after, round((a - b) * 100.0, 6) AS points
FROM halves""",
)


def _difference(column: str, name: str) -> str:
    x = f"avg({column}::DOUBLE) FILTER (post_cutoff = "
    return f"round({x}1) - {x}0), 6) AS {name}_shift"


ORACLES["product_shift"] = _sql(
    BASE,
    f"""SELECT product_group, count(*) FILTER (post_cutoff = 0) AS n_before,
  count(*) FILTER (post_cutoff = 1) AS n_after, {_difference('n_words', 'words')},
  {_difference('legal_term_count', 'legal_terms')},
  {_difference('template_phrase_count', 'template_phrases')},
  {_difference('any_relief', 'any_relief')}
FROM modeling GROUP BY product_group""",
)
ORACLES["topic_shift"] = _sql(
    _CLEAN,
    """, counts AS (
  SELECT sub_issue AS topic, count(*) FILTER (post_cutoff = 0) AS n_before,
    count(*) FILTER (post_cutoff = 1) AS n_after
  FROM modeling0 WHERE sub_issue IS NOT NULL GROUP BY 1)
SELECT topic, n_before, n_after, round(b, 6) AS share_before, round(a, 6) AS share_after,
  round((a - b) * 100.0, 6) AS points
FROM (SELECT *, n_before::DOUBLE / sum(n_before) OVER () AS b,
  n_after::DOUBLE / sum(n_after) OVER () AS a FROM counts)""",
)
ORACLES["product_topic"] = _sql(
    _CLEAN,
    """SELECT product_group, topic, n,
  round(n::DOUBLE / sum(n) OVER (PARTITION BY product_group), 6) AS share
FROM (SELECT product_group, sub_issue AS topic, count(*) AS n
  FROM modeling0 WHERE sub_issue IS NOT NULL GROUP BY ALL)""",
)
ORACLES["normalize_text"] = _sql(
    f"{RAW}, {DOCS}",
    rf"""SELECT complaint_id, trim(regexp_replace(regexp_replace(regexp_replace(
    lower(consumer_narrative),
    '[0-9x]{{1,4}}/[0-9x]{{1,2}}/[0-9x]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', '<date>', 'g'),
    '\{{\$[0-9,]+(\.[0-9]+)?\}}|\$[0-9,]+(\.[0-9]+)?', '<amount>', 'g'),
    '[' || {_BLANKS} || ']+', ' ', 'g'), {_BLANKS}) AS normalized
FROM docs""",
)
_DIMS = ("legal_density", "evidence_density", "avg_sentence_len", "connective_density", "n_paragraphs", "template_density")
_PARTS = ("", "", " / 3", " / 3", " / 3", "")
_INDEX = f"""{BASE}, dense AS (
  SELECT *, legal_term_count::DOUBLE / greatest(n_words, 1) AS legal_density,
    evidence_term_count::DOUBLE / greatest(n_words, 1) AS evidence_density,
    template_phrase_count::DOUBLE / greatest(n_words, 1) AS template_density,
    connective_count::DOUBLE / greatest(n_words, 1) AS connective_density FROM modeling),
stats AS (
  SELECT {', '.join(f'avg({d}) AS {d}_m, stddev_pop({d}) AS {d}_s' for d in _DIMS)} FROM dense),
indexed AS (
  SELECT dense.*, ({' + '.join(
      f'CASE WHEN {d}_s > 0 THEN ({d} - {d}_m) / {d}_s{p} ELSE 0.0 END' for d, p in zip(_DIMS, _PARTS, strict=True))}) / 4.0
    AS expression_index
  FROM dense, stats)"""
ORACLES["expression_index"] = _sql(
    _INDEX, "SELECT complaint_id, round(expression_index, 6) AS expression_index FROM indexed"
)


def _pca_index() -> str:
    """Scores on the leading eigenvector of the correlations, by power iteration."""
    dims = range(len(_DIMS))
    scores = ", ".join(
        f"CASE WHEN {d}_s > 0 THEN ({d} - {d}_m) / {d}_s ELSE 0.0 END AS z{i}" for i, d in enumerate(_DIMS)
    )
    products = ", ".join(f"avg(z{i} * z{j}) AS c{i}{j}" for i in dims for j in dims)
    turned = ", ".join(" + ".join(f"c{i}{j} * v{j}" for j in dims) + f" AS u{i}" for i in dims)
    length = "sqrt(" + " + ".join(f"u{i} * u{i}" for i in dims) + ")"
    steps = _INDEX + f""", standard AS (SELECT complaint_id, {scores} FROM dense, stats),
correlations AS (SELECT {products} FROM standard),
power AS (
  SELECT 0 AS step, {', '.join(f'{1.0 + 0.1 * i}::DOUBLE AS v{i}' for i in dims)}
  UNION ALL
  SELECT step + 1, {', '.join(f'u{i} / {length}' for i in dims)}
  FROM (SELECT step, {turned} FROM power, correlations WHERE step < 400)),
first_axis AS (SELECT *, CASE WHEN {' + '.join(f'v{i}' for i in dims)} >= 0 THEN 1.0 ELSE -1.0 END AS sign
  FROM power WHERE step = 400)"""
    score = " + ".join(f"z{i} * v{i}" for i in dims)
    select = f"SELECT complaint_id, round(({score}) * sign, 6) AS pca_index FROM standard, first_axis"
    return _sql(steps, select).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES["pca_index"] = _pca_index()
_PAIRS = """, pairs AS (
  SELECT a.complaint_id, b.complaint_id AS neighbour_id, a.expression_index AS mine,
    b.expression_index AS theirs,
    CAST(coalesce(a.issue = b.issue, FALSE) AS INTEGER)
      + CAST(coalesce(a.company = b.company, FALSE) AS INTEGER)
      + CAST(coalesce(a.state = b.state, FALSE) AS INTEGER)
      + CAST(month(a.date_received) = month(b.date_received) AS INTEGER) AS matches
  FROM indexed a JOIN indexed b ON a.product_group = b.product_group
  WHERE a.post_cutoff = 1 AND b.post_cutoff = 0),
nearest AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY complaint_id ORDER BY matches DESC, neighbour_id) AS INTEGER) AS rank
  FROM pairs QUALIFY rank <= 5)"""
ORACLES["matched_neighbours"] = _sql(
    _INDEX + _PAIRS, "SELECT complaint_id, neighbour_id, matches, rank FROM nearest"
)
_SHIFTED = """, means AS (
  SELECT complaint_id, count(*) AS neighbours, avg(theirs) AS neighbour_mean
  FROM nearest GROUP BY complaint_id),
shifted AS (
  SELECT i.*, coalesce(neighbours, 0) AS neighbours, neighbour_mean,
    expression_index - neighbour_mean AS local_shift
  FROM indexed i LEFT JOIN means m ON i.complaint_id = m.complaint_id WHERE post_cutoff = 1)"""
ORACLES["local_shift"] = _sql(
    _INDEX + _PAIRS + _SHIFTED,
    """SELECT complaint_id, neighbours, round(neighbour_mean, 6) AS neighbour_mean,
  round(local_shift, 6) AS local_shift FROM shifted""",
)
ORACLES["time_split"] = _sql(
    _CLEAN,
    """SELECT complaint_id, complaint_month, CASE WHEN date_received::DATE
  <= (SELECT quantile_disc(date_received::DATE, 0.75) FROM modeling0)
  THEN 'train' ELSE 'test' END AS part
FROM modeling0""",
)
ORACLES["cv_folds"] = _sql(_CLEAN, f"SELECT complaint_id, {_fold(5)} AS fold FROM modeling0")
ORACLES["event_study"] = _sql(
    _INDEX,
    """SELECT CAST((year(date_received) - 1998) * 12 + month(date_received) - 6 AS INTEGER)
    AS month_offset, count(*) AS n, round(avg(expression_index), 6) AS mean_value
FROM indexed GROUP BY 1""",
)
ORACLES["linear_attribution"] = _sql(
    BASE,
    "\nUNION ALL ".join(
        f"""SELECT '{f}' AS feature, round(c, 6) AS coef, round(abs(c) * d, 6) AS mean_abs_contribution
FROM (SELECT CASE WHEN stddev_pop({f}) > 0 THEN corr({f}, any_relief) ELSE 0.0 END AS c,
  avg(abs({f} - (SELECT avg({f}) FROM modeling))) AS d FROM modeling)"""
        for f in NUMERIC_FEATURES
    ),
)
_CONTROLS = ("n_words", "n_sentences", "lexical_diversity", "uppercase_ratio")


def _residuals(kept: str = "product_group, state") -> str:
    """Outcome and treatment after the controls, cross-fitted over two folds.

    Each control in turn is taken out of what is left, with sums over the fold's
    training rows; after the last one the residuals are those of the joint regression.
    """
    names = ["y", "t", *(f"x{i}" for i in range(len(_CONTROLS)))]
    centred = ", ".join(f"{n} - avg({n}) FILTER (train) OVER w AS {n}" for n in names)
    steps = f""", folded AS (
  SELECT {kept}, {_fold(2)} AS fold, CAST(any_relief AS DOUBLE) AS y, local_shift AS t,
    {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in enumerate(_CONTROLS))}
  FROM shifted WHERE local_shift IS NOT NULL),
roles AS (SELECT f.*, part, fold <> part AS train FROM folded f, (VALUES (0), (1)) parts(part)),
step0 AS (SELECT {kept}, part, train, {centred} FROM roles WINDOW w AS (PARTITION BY part))"""
    for i in range(len(_CONTROLS)):
        left = ["y", "t", *(f"x{j}" for j in range(i + 1, len(_CONTROLS)))]
        taken = ", ".join(
            f"{n} - x{i} * (sum({n} * x{i}) FILTER (train) OVER w / sum(x{i} * x{i}) FILTER (train) OVER w)"
            f" AS {n}"
            for n in left
        )
        steps += f""",
step{i + 1} AS (SELECT {kept}, part, train, {taken} FROM step{i} WINDOW w AS (PARTITION BY part))"""
    return steps + f""",
residuals AS (SELECT {kept}, y AS ry, t AS rt FROM step{len(_CONTROLS)} WHERE NOT train)"""


_RESIDUALS = _INDEX + _PAIRS + _SHIFTED + _residuals()
ORACLES["partial_linear"] = _sql(
    _RESIDUALS,
    """, slopes AS (SELECT count(*) AS n, sum(rt * ry) / sum(rt * rt) AS slope, sum(rt * rt) AS tt
  FROM residuals)
SELECT any_value(n) AS n, round(any_value(slope), 6) AS slope,
  round(sqrt(sum((rt * (ry - slope * rt)) ** 2)) / any_value(tt), 6) AS std_error
FROM residuals, slopes""",
)
for _name, _by in (("slope_by_group", "product_group"), ("partial_linear_groups", "state")):
    ORACLES[_name] = _sql(
        _RESIDUALS,
        f"""SELECT {_by}, count(*) AS n,
  CASE WHEN var_pop(rt) > 0 THEN round(covar_pop(rt, ry) / var_pop(rt), 6) END AS slope
FROM residuals WHERE {_by} IS NOT NULL GROUP BY {_by}""",
    )
ORACLES["effect_heterogeneity"] = _sql(
    _INDEX + _PAIRS + _SHIFTED + _residuals("product_group, company, state, complaint_month"),
    ", long AS ("
    + " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, {d} AS level, complaint_month AS month, ry, rt
  FROM residuals WHERE {d} IS NOT NULL"""
        for d in ("product_group", "company", "state")
    )
    + """),
centred AS (
  SELECT *, rt - avg(rt) OVER w AS t, ry - avg(ry) OVER w AS y FROM long WINDOW w AS (PARTITION BY dimension, level)),
fits AS (
  SELECT dimension, level, count(*) AS n, count(DISTINCT month) AS clusters, sum(t * t) AS tt,
    CASE WHEN sum(t * t) > 1e-12 * sum(rt * rt) THEN sum(t * y) / sum(t * t) END AS slope
  FROM centred GROUP BY ALL),
months AS (
  SELECT dimension, level, month, sum(t * (y - slope * t)) AS s FROM centred JOIN fits USING (dimension, level) GROUP BY ALL),
errors AS (
  SELECT f.*, CASE WHEN clusters >= 5 THEN sqrt(ss * clusters / (clusters - 1)) / tt END AS std_error
  FROM fits f JOIN (SELECT dimension, level, sum(s * s) AS ss FROM months GROUP BY ALL) USING (dimension, level)),
weighed AS (SELECT *, CASE WHEN std_error > 0 THEN 1 / (std_error * std_error) END AS w FROM errors),
centres AS (SELECT dimension, sum(w * slope) / sum(w) AS centre FROM weighed GROUP BY dimension),
totals AS (
  SELECT dimension, any_value(centre) AS centre, greatest(0.0, coalesce((sum(w * (slope - centre) ** 2) - (count(w) - 1))
    / nullif(sum(w) - sum(w * w) / sum(w), 0), 0.0)) AS tau2
  FROM weighed JOIN centres USING (dimension) GROUP BY dimension)
SELECT dimension, level, n, clusters, round(slope, 6) AS slope, round(std_error, 6) AS std_error, round(tau2, 6) AS tau2,
  round(CASE WHEN w IS NULL THEN centre ELSE (slope * tau2 + centre / w) / (tau2 + 1 / w) END, 6) AS shrunk_slope,
  round(sqrt(CASE WHEN w IS NULL THEN tau2 ELSE tau2 / w / (tau2 + 1 / w) END), 6) AS shrunk_error
FROM weighed JOIN totals USING (dimension)""",
)
ORACLES["top_features_given"] = _sql(
    BASE,
    ", found AS ("
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, CASE WHEN stddev_pop({f}) > 0 THEN corr({f}, any_relief)
  ELSE 0.0 END AS coef FROM modeling"""
        for f in NUMERIC_FEATURES
    )
    + """)
SELECT feature, round(coef, 6) AS coef, round(abs(coef), 6) AS abs_coef, direction FROM (
  SELECT *, 'positive' AS direction FROM (SELECT * FROM found ORDER BY coef DESC, feature LIMIT 6)
  UNION ALL
  SELECT *, 'negative' FROM (SELECT * FROM found ORDER BY coef, feature LIMIT 6))""",
)

# --- the logistic solver -----------------------------------------------------
_TERMS = VOCABULARY.strip().replace("LIMIT 8000", "LIMIT 6000")
ORACLES["response_gradient"] = _sql(
    _CLEAN,
    f"""{_SPLIT}, train AS (
  SELECT m.complaint_id, m.consumer_narrative, {_FILLED} FROM modeling0 m
  JOIN parted USING (complaint_id) WHERE part = 'train'),
docs AS (SELECT complaint_id, consumer_narrative FROM train), {_TERMS},
levels AS (
  SELECT 'product_group=' AS variable, product_group AS level FROM train
  UNION ALL SELECT 'submitted_via=', submitted_via FROM train
  UNION ALL SELECT 'state=', state FROM train),
encoded AS (
  SELECT variable || CASE WHEN count(*) >= 10 THEN level ELSE 'infrequent' END AS feature
  FROM levels GROUP BY variable, level)
SELECT term AS feature, TRUE AS settled FROM chosen
UNION ALL SELECT DISTINCT feature, TRUE FROM encoded
UNION ALL SELECT unnest([{_quoted(NUMERIC_FEATURES)}, '(intercept)']), TRUE""",
)

_MARGIN = "1 / (1 + exp(-(a * x + b)))"
_ONE_NUMBER = f"""{BASE}, sizes AS (SELECT any_relief, count(*) AS of_class, sum(count(*)) OVER () AS total
  FROM modeling GROUP BY any_relief),
inputs AS (
  SELECT complaint_id, any_relief AS y, n_words / 100.0::DOUBLE AS x, total::DOUBLE / (2 * of_class) AS w
  FROM modeling JOIN sizes USING (any_relief)),
newton AS (
  SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab),
    b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT step, a, b, a + sum(w * (p - y) * x) AS ga, b + sum(w * (p - y)) AS gb,
      1 + sum(w * p * (1 - p) * x * x) AS haa, sum(w * p * (1 - p) * x) AS hab, 1 + sum(w * p * (1 - p)) AS hbb
    FROM (SELECT step, a, b, w, y, x, {_MARGIN} AS p FROM newton, inputs) GROUP BY step, a, b)
  WHERE step < 30)"""
ORACLES["logistic_scores"] = _sql(
    _ONE_NUMBER,
    f"""SELECT complaint_id, y AS label, round({_MARGIN}, 6) AS score, round(a, 6) AS coef, round(b, 6) AS intercept
FROM inputs, newton WHERE step = 30""",
).replace("WITH", "WITH RECURSIVE", 1)
ORACLES["calibrated_logistic"] = _sql(
    f"""{_ONE_NUMBER}, scored AS (
  SELECT {_fold(2)} AS fold, y AS label, {_MARGIN} AS score FROM inputs, newton WHERE step = 30),
halves AS (SELECT * FROM scored WHERE fold = 0){_RISING.format(rows='halves')},
calibrated AS (
  SELECT label, s.score, coalesce(rate, (SELECT min(rate) FROM rising)) AS rate
  FROM scored s ASOF LEFT JOIN rising r ON s.score >= r.score WHERE fold = 1)""",
    "\nUNION ALL ".join(
        f"""SELECT '{stage}' AS stage, CAST(least(floor({value} * 10), 9) AS INTEGER) AS bin, count(*) AS n,
  round(avg({value}), 6) AS mean_score, round(avg(label::DOUBLE), 6) AS positive_rate
FROM calibrated GROUP BY ALL"""
        for stage, value in (("before", "score"), ("after", "rate"))
    ),
).replace("WITH", "WITH RECURSIVE", 1)


def _first_tree(features: Iterable[str], rate: float = 0.3) -> str:
    """The best splits of one tree of depth two, every value a threshold: sums over sorted values."""
    long = " UNION ALL ".join(
        f"SELECT complaint_id, {i} AS f, '{c}' AS feature, {c}::DOUBLE AS x FROM nodes0" for i, c in enumerate(features)
    )

    def best(source: str, name: str) -> str:
        """Best split of each node in ``source`` (complaint_id, node, g, h)."""
        return f"""
{name}_total AS (SELECT node, sum(g) AS g, sum(h) AS h FROM {source} GROUP BY node),
{name}_values AS (
  SELECT s.node, e.f, e.feature, e.x, sum(s.g) AS g, sum(s.h) AS h
  FROM {source} s JOIN entries e USING (complaint_id) WHERE e.x <> 0 GROUP BY ALL),
{name}_upto AS (
  SELECT *, sum(g) OVER up AS ug, sum(h) OVER up AS uh, sum(g) OVER (PARTITION BY node, f) AS wg,
    sum(h) OVER (PARTITION BY node, f) AS wh
  FROM {name}_values WINDOW up AS (PARTITION BY node, f ORDER BY x)),
{name}_sides AS (
  SELECT u.node, f, feature, x, z, ug + z * (t.g - wg) AS lg, uh + z * (t.h - wh) AS lh, t.g, t.h
  FROM {name}_upto u JOIN {name}_total t ON u.node = t.node, (VALUES (0), (1)) zero(z)),
{name}_best AS (
  SELECT *, lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1) AS gain FROM {name}_sides
  WHERE lh >= 1 AND h - lh >= 1
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, x, z) = 1 AND round(gain, 9) > 0),
{name}_edge AS (
  SELECT b.*, CASE WHEN b.x < m.most THEN b.x END AS threshold
  FROM {name}_best b JOIN (SELECT f, max(x) AS most FROM entries WHERE x <> 0 GROUP BY f) m ON m.f = b.f),
{name}_next AS (
  SELECT s.complaint_id, CASE WHEN CASE WHEN e.x = 0 THEN b.z = 1 ELSE e.x <= b.x END
    THEN 2 * s.node + 1 ELSE 2 * s.node + 2 END AS node, s.g, s.h
  FROM {source} s JOIN {name}_edge b ON s.node = b.node JOIN entries e ON e.complaint_id = s.complaint_id AND e.f = b.f)"""

    return _sql(
        BASE,
        f""", sizes AS (SELECT any_relief, count(*) AS of_class, sum(count(*)) OVER () AS total
  FROM modeling GROUP BY any_relief),
nodes0 AS (
  SELECT m.*, 0 AS node, total::DOUBLE / (2 * of_class) * (0.5 - any_relief) AS g,
    total::DOUBLE / (2 * of_class) * 0.25 AS h
  FROM modeling m JOIN sizes USING (any_relief)),
entries AS ({long}),
root AS (SELECT complaint_id, node, g, h FROM nodes0),
{best("root", "one").strip()},
{best("one_next", "two").strip()},
splits AS (SELECT * FROM one_edge UNION ALL SELECT * FROM two_edge),
rest AS (
  SELECT node, g, h FROM one_next WHERE node NOT IN (SELECT node FROM two_edge)
  UNION ALL SELECT node, g, h FROM two_next)
SELECT CAST(node AS INTEGER) AS node, feature, round(threshold, 6) AS threshold, z = 1 AS zero_left,
  round(gain, 6) AS gain, NULL::DOUBLE AS value FROM splits
UNION ALL
SELECT CAST(node AS INTEGER), NULL, NULL, NULL, NULL, round(-{rate}::DOUBLE * sum(g) / (sum(h) + 1), 6) FROM rest
GROUP BY node""",
    )


ORACLES["gbt_first_tree"] = _first_tree(("n_sentences", "question_count", "exclamation_count", "digit_count"))


# --- fits by fold --------------------------------------------------------------
_EARLIER = """, days AS (
  SELECT CAST(date_received AS DATE) AS day, count(*) AS n FROM modeling0 GROUP BY ALL),
running AS (SELECT day, sum(n) OVER (ORDER BY day) AS upto, sum(n) OVER () AS total FROM days),
last_day AS (SELECT min(day) AS day FROM running WHERE upto >= total * 0.75::DOUBLE),
folds AS (SELECT unnest([0, 1, 2]) AS fold)"""
_OTHERS = f"{_EARLIER}, others AS (SELECT f.fold, m.* FROM folds f, {{rows}} m, last_day WHERE CAST(date_received AS DATE) <= last_day.day AND {_fold(3)} <> f.fold)"

ORACLES["fold_vocabulary"] = _sql(
    _CLEAN,
    _OTHERS.format(rows="modeling0")
    + f""", docs AS (SELECT fold || '|' || complaint_id AS complaint_id, consumer_narrative FROM others),
{VOCABULARY.strip().split("term_counts AS")[0].rstrip().rstrip(",")},
counts AS (
  SELECT CAST(split_part(complaint_id, '|', 1) AS INTEGER) AS fold, term, sum(tf) AS cf, count(*) AS df
  FROM doc_terms GROUP BY ALL),
sizes AS (SELECT fold, count(*) AS n FROM others GROUP BY fold),
chosen AS (
  SELECT fold, term, cf, df, ln((n + 1)::DOUBLE / (df + 1)) + 1.0 AS idf
  FROM counts JOIN sizes USING (fold) WHERE df >= 5 AND df <= 0.9 * n
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY cf DESC, term) <= 6000)
SELECT fold, term, CAST(row_number() OVER (PARTITION BY fold ORDER BY term) - 1 AS INTEGER) AS term_id,
  CAST(cf AS BIGINT) AS cf, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM chosen""",
)
ORACLES["fold_levels"] = _sql(
    _CLEAN,
    _OTHERS.format(rows="modeling0")
    + f""", filled AS (SELECT fold, {_FILLED} FROM others),
levels AS (
  SELECT fold, 'product_group' AS variable, product_group AS level FROM filled
  UNION ALL SELECT fold, 'submitted_via', submitted_via FROM filled
  UNION ALL SELECT fold, 'state', state FROM filled)
SELECT fold, variable, level, count(*) AS n, CASE WHEN count(*) >= 10 THEN level ELSE 'infrequent' END AS encoded
FROM levels GROUP BY fold, variable, level""",
)
ORACLES["fold_scales"] = _sql(
    BASE,
    _OTHERS.format(rows="modeling")
    + f""", sds AS (
  SELECT fold, {', '.join(f'CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END::DOUBLE AS {c}' for c in NUMERIC_FEATURES)}
  FROM others GROUP BY fold)
SELECT fold, feature, round(sd, 6) AS sd FROM sds UNPIVOT (sd FOR feature IN ({', '.join(NUMERIC_FEATURES)}))""",
)

_ABSORBED = ("product_group", "company", "state", "complaint_month")
ORACLES["absorbed_means"] = _sql(
    _CLEAN,
    " UNION ALL ".join(
        f"""SELECT '{g}' AS variable, coalesce({g}, 'Missing') AS level, count(*) AS n,
  0.0::DOUBLE AS relief, 0.0::DOUBLE AS length FROM modeling0 GROUP BY ALL"""
        for g in _ABSORBED
    ),
)
