"""SQL of the queries for DuckDB, written apart from the DataFrame operators it checks."""

from __future__ import annotations

from ..functions.language import ARABIC_SCRIPT, LATIN_SCRIPT, NAMES
from ..functions.text import ABBREVIATIONS, REFERENCE_TITLES, SECTION_TITLES
from ..operators import citations as ci
from ..operators import paraphrase as pa
from ..operators import writing as wr
from ..operators.similarity import minhash_constants
from .fixtures import values_sql

W = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"
DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
PAIRS = "(SELECT * FROM evidence WHERE source_text IS NOT NULL AND submitted_text IS NOT NULL)"


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def whole(pattern: str) -> str:
    """A pattern whose word boundaries know letters of all alphabets, for tests only (it takes one character more)."""
    head, flags = (pattern[4:], "(?i)") if pattern.startswith("(?i)") else (pattern, "")
    if head.startswith(r"\b"):
        head = r"(?:^|[^\p{L}\p{N}\p{M}_])" + head[2:]
    if head.endswith(r"\b"):
        head = head[:-2] + r"(?:$|[^\p{L}\p{N}\p{M}_])"
    return flags + head


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


def toks(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def pcs(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{W}+'), lambda x: x <> '')"


def grams(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string(list_slice({w}, i, i + {n} - 1), ' '))"


def clean(c: str) -> str:
    c = f"regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return trim(c)


def sents(c: str, protect: bool = True) -> str:
    if protect:
        for a in ABBREVIATIONS:
            c = f"replace({c}, {q(a)}, {q(a).replace('.', '@@')})".replace("@@", "' || chr(1) || '")
    c = f"regexp_split_to_array(regexp_replace({c}, '([.!?]){W}+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    back = "replace(x, chr(1), '.')" if protect else "x"
    return f"list_filter(list_transform({c}, lambda x: {trim(back)}), lambda x: x <> '')"


def style_sents(c: str) -> str:
    flat = f"regexp_replace({c}, '{W}+', ' ', 'g')"
    return f"list_filter({sents(flat, False)}, lambda x: length(x) > 5)"


def unit(c: str) -> str:
    return f"greatest(0.0, least(1.0, {c}))"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def md5_64(c: str) -> str:
    """First eight bytes of the MD5, least significant first, as an unsigned number."""
    return f"md5_number_upper({c})"


def _references() -> str:
    titles = ", ".join(q(t) for t in REFERENCE_TITLES)
    return rf"""
lines AS (SELECT doc_id, unnest(range(len(s))) AS n, {trim('unnest(s)')} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {DOCS})),
opening AS (SELECT doc_id, min(n) AS b FROM lines WHERE regexp_replace(lower(line), '\s+', ' ', 'g') IN ({titles}) GROUP BY doc_id),
rest AS (SELECT l.doc_id, n, line, CASE WHEN line = '' OR regexp_matches(line, {q(ci.NEW_ENTRY)}) OR coalesce(lag(line) OVER w = '', true) THEN 1 ELSE 0 END AS opens
  FROM lines l JOIN opening USING (doc_id) WHERE n > b WINDOW w AS (PARTITION BY l.doc_id ORDER BY n)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM rest),
merged AS (SELECT doc_id, e, string_agg(line, ' ' ORDER BY n) AS entry FROM numbered WHERE line <> '' GROUP BY doc_id, e),
entries AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS entry_index, entry FROM merged WHERE length(entry) > 20)"""


def _cited() -> str:
    return rf"""
numeric AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(ci.NUMERIC)})) AS raw FROM {DOCS}),
part AS (SELECT doc_id, unnest(string_split(regexp_replace(raw, '[\[\]\s]', '', 'g'), ',')) AS p FROM numeric),
bound AS (SELECT doc_id, regexp_split_to_array(p, '[-–]') AS b FROM part),
cited AS (SELECT doc_id, number, count(*) AS times FROM (SELECT doc_id, unnest(range(b[1]::BIGINT, b[len(b)]::BIGINT + 1)) AS number FROM bound WHERE len(b) <= 2) GROUP BY doc_id, number)"""


def _fields(raw: str) -> str:
    """Select list of the parsed fields of a reference entry."""
    br, lo = f"regexp_extract({raw}, '\\(([0-9]{{4}}[a-z]?)\\)', 1)", f"regexp_extract({raw}, '\\b((?:19|20)[0-9]{{2}})\\b', 1)"
    before = f"CASE WHEN {br} <> '' THEN regexp_extract({raw}, '^((?s:.*?))\\([0-9]{{4}}[a-z]?\\)', 1) WHEN {lo} <> '' THEN regexp_extract({raw}, '^((?s:.*?))\\b(?:19|20)[0-9]{{2}}\\b', 1) ELSE '' END"
    after = f"CASE WHEN {br} <> '' THEN regexp_extract({raw}, '\\([0-9]{{4}}[a-z]?\\)((?s:.*))$', 1) WHEN {lo} <> '' THEN regexp_extract({raw}, '\\b(?:19|20)[0-9]{{2}}\\b((?s:.*))$', 1) ELSE '' END"
    names = f"regexp_split_to_array(regexp_replace(regexp_replace({before}, '^\\s*\\[[0-9]+\\]\\s*', ''), '^\\s*[0-9]+\\.\\s*', ''), ',|&|\\band\\b')"
    authors = f"list_slice(list_transform(list_filter(list_transform({names}, lambda a: {trim('a')}), lambda a: length(a) BETWEEN 3 AND 49), lambda a: regexp_replace(a, '[.,&]+$', '')), 1, 6)"
    title = f"substring({trim(f'''regexp_extract(regexp_replace({after}, '^[\\)\\.\\s]+', ''), '^([^.\\n]{{10,200}})', 1)''')}, 1, 200)"
    doi = r"'\b(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)'"
    return f"""CASE WHEN regexp_matches({raw}, '^\\s*\\[([0-9]+)\\]') THEN regexp_extract({raw}, '^\\s*\\[([0-9]+)\\]', 1)::BIGINT END AS ref_number,
  coalesce(nullif({br}, ''), nullif({lo}, '')) AS year, nullif(regexp_extract({raw}, {doi}, 1), '') AS doi,
  CASE WHEN {br} = '' AND {lo} = '' THEN CAST([] AS VARCHAR[]) ELSE {authors} END AS author_list, {title} AS title, {trim(f"regexp_extract({raw}, {q(ci.JOURNAL)}, 1)")} AS journal"""


def _heading(c: str) -> str:
    s, n = trim(c), f"len({pcs(trim(c))})"
    titles = ", ".join(q(t) for t in SECTION_TITLES)
    return rf"""({s} <> '' AND {n} <= 12 AND length({s}) <= 100
 AND NOT (ends_with({s}, '.') AND NOT ends_with({s}, '...') AND NOT regexp_matches({s}, '^[0-9]+\.{W}'))
 AND (regexp_matches({s}, '^(?i:chapter|section|part){W}+[0-9]+') OR regexp_matches({s}, '^[0-9]+\.([0-9]+)?{W}+[A-Z]') OR regexp_matches({s}, '^[IVX]+\.{W}+[A-Z]') OR lower({s}) IN ({titles})
  OR (regexp_matches({s}, '\p{{Lu}}') AND NOT regexp_matches({s}, '\p{{Ll}}') AND {n} BETWEEN 2 AND 10)
  OR ({n} BETWEEN 2 AND 8 AND len(list_filter({pcs(s)}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= {n} * 0.8 AND NOT ends_with({s}, '.'))))"""


def _latest(t: str, key: str, order: str) -> str:
    return f"(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


FINDINGS = _latest("findings", "finding_id", "created_at DESC NULLS LAST, loaded_at DESC NULLS LAST, confidence DESC NULLS LAST")


def _prints() -> str:
    sub = " + ".join(f"regexp_matches(lower(x), {q(whole(chr(92) + "b" + w + chr(92) + "b"))})::BIGINT" for w in wr.SUBORDINATORS)
    words = ", ".join(q(w) for w in wr.FUNCTION_WORDS)
    syll = "greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)"
    mean = "(list_sum(l)::DOUBLE / k)"
    return f"""
base AS (SELECT doc_id, t, {toks('t')} AS w, {style_sents('t')} AS s, len({pcs('t')}) >= 30 AS ok FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
facts AS (SELECT *, len(w) AS n, len(s) AS k, list_transform(s, lambda x: len({pcs('x')})) AS l FROM base),
prints AS (SELECT doc_id, CASE WHEN ok AND k > 0 THEN {mean} ELSE 0.0 END AS sentence_length,
  CASE WHEN ok AND k > 0 THEN sqrt((k * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l))::DOUBLE) / k ELSE 0.0 END AS sentence_deviation,
  CASE WHEN ok AND n > 0 THEN len(list_distinct(w))::DOUBLE / n ELSE 0.0 END AS richness,
  CASE WHEN ok THEN (length(t) - length(translate(t, {q(wr.STYLE_MARKS)}, '')))::DOUBLE / greatest(length(t), 1) ELSE 0.0 END AS punctuation,
  CASE WHEN ok AND n > 0 THEN len(list_filter(w, lambda x: x IN ({words})))::DOUBLE / n ELSE 0.0 END AS function_words,
  CASE WHEN ok AND n > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / n ELSE 0.0 END AS word_length,
  CASE WHEN ok AND n > 0 AND k > 0 THEN {unit(f"(206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / k) - 84.6::DOUBLE * (list_sum(list_transform(w, lambda x: {syll}))::DOUBLE / n)) / 100")} ELSE 0.0 END AS readability,
  CASE WHEN ok AND k > 0 THEN list_sum(list_transform(s, lambda x: {sub}))::DOUBLE / k ELSE 0.0 END AS complexity,
  CASE WHEN ok THEN n ELSE 0 END AS word_count, CASE WHEN ok THEN k ELSE 0 END AS sentence_count FROM facts)"""


def _round(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    out["clean_text"] = f"SELECT doc_id, {clean('text')} AS clean FROM {DOCS}"
    out["word_counts"] = f"SELECT doc_id, len({pcs('text')}) AS pieces, len({toks('text')}) AS words FROM {DOCS}"
    out["tokens_topk"] = f"SELECT word, count(*) AS n FROM (SELECT unnest({toks('text')}) AS word FROM {DOCS}) GROUP BY word ORDER BY n DESC, word LIMIT 100"
    out["ngram_freq"] = f"WITH t AS (SELECT doc_id, {toks('text')} AS w FROM {DOCS}), g AS (SELECT doc_id, unnest({grams('w', 3)}) AS gram FROM t) SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= 3"
    out["sentences"] = f"SELECT doc_id, unnest(range(len(s))) AS sentence_index, unnest(s) AS sentence FROM (SELECT doc_id, {sents('text')} AS s FROM {DOCS})"
    out["paragraphs"] = rf"""WITH c AS (SELECT doc_id, {clean('text')} AS t FROM {DOCS}), b AS (SELECT doc_id, t, regexp_split_to_array(t, '\n{W}*\n') AS p FROM c),
raw AS (SELECT doc_id, CASE WHEN len(p) < 3 THEN string_split(t, chr(10)) ELSE p END AS p FROM b),
pieces AS (SELECT doc_id, unnest(range(len(p))) AS n, {trim('unnest(p)')} AS x FROM raw),
flagged AS (SELECT *, (x <> '' AND length(x) < 40) AS short FROM pieces),
islands AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, short ORDER BY n) AS g FROM flagged),
joined AS (SELECT doc_id, min(n) AS n, string_agg(x, ' ' ORDER BY n) AS paragraph FROM islands WHERE short GROUP BY doc_id, g UNION ALL SELECT doc_id, n, x FROM islands WHERE NOT short AND x <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS paragraph_index, paragraph FROM joined WHERE length(paragraph) >= 40"""
    out["headings"] = f"SELECT DISTINCT doc_id, paragraph_index::BIGINT AS paragraph_index, text FROM paragraphs WHERE {_heading('text')}"
    out["chunks_200_40"] = f"""WITH t AS (SELECT doc_id, {pcs('text')} AS w FROM {DOCS}), c AS (SELECT doc_id, w, unnest(CASE WHEN len(w) > 200 THEN range(1, len(w) + 1, 160) ELSE [1] END) AS i FROM t WHERE len(w) > 0),
p AS (SELECT doc_id, i, list_slice(w, i, i + 199) AS c FROM c) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, array_to_string(c, ' ') AS chunk FROM p WHERE i = 1 OR len(c) >= 20"""
    out["document_keys"] = f"SELECT doc_id, substring(sha256(text), 1, 16) AS key FROM {DOCS}"
    out["references_section"] = f"WITH {_references()} SELECT doc_id, entry_index, entry FROM entries"
    # written apart from the operator's patterns: numbers in brackets, one name and a year, an identifier
    name = r"[A-Z][a-zA-Z-]+"
    kinds = (("numeric", r"\[\d+(?:[-,\s]+\d+)*\]"), ("author_year", rf"\({name}(?:\s+et\s+al\.?)?,?\s+\d{{4}}[a-z]?\)"), ("author_year", rf"{name}\s+\(\d{{4}}[a-z]?\)"), ("doi", r"\b10\.\d{4,9}/[A-Za-z0-9._;()/:-]+\b"))
    union = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {q(p)})) AS raw FROM {DOCS}" for k, p in kinds)
    out["inline_citations"] = f"SELECT doc_id, kind, raw, count(*) AS times FROM ({union}) GROUP BY doc_id, kind, raw"
    listed = f"listed AS (SELECT DISTINCT doc_id, ref_number AS number FROM (SELECT doc_id, {_fields('entry')} FROM entries) WHERE ref_number IS NOT NULL)"
    out["citation_issues"] = f"""WITH {_references()}, {_cited()}, {listed}
SELECT doc_id, 'missing_reference' AS issue, number, times FROM cited c ANTI JOIN listed l USING (doc_id, number) UNION ALL
SELECT doc_id, 'unused_reference', number, 0 FROM listed ANTI JOIN cited USING (doc_id, number) UNION ALL SELECT doc_id, 'excessive_citation', number, times FROM cited WHERE times >= 3"""
    out["citation_coverage"] = f"WITH {_references()}, {_cited()}, {listed} SELECT l.doc_id, count(*) AS listed, round(count(c.number)::DOUBLE / count(*), 6) AS coverage FROM listed l LEFT JOIN cited c USING (doc_id, number) GROUP BY l.doc_id"
    out["uncited_claims"] = f"""WITH s AS (SELECT doc_id, unnest({sents('text')}) AS s FROM {DOCS}) SELECT doc_id, substring(s, 1, 200) AS sentence, regexp_extract(s, {q(ci.CLAIM)}) AS matched FROM s
WHERE regexp_matches(s, {q(ci.CLAIM)}) AND NOT regexp_matches(s, {q(ci.NUMERIC)}) AND NOT regexp_matches(s, {q(ci.AUTHOR_YEAR)}) AND len({pcs('s')}) >= 6"""
    out["reference_fields"] = f"WITH {_references()}, f AS (SELECT doc_id, entry_index, {_fields('entry')} FROM entries) SELECT doc_id, entry_index, ref_number, year, doi, array_to_string(author_list, '|') AS authors, title, journal FROM f"
    has = lambda c, ws: "(" + " OR ".join(f"contains({c}, {q(w)})" for w in ws) + ")"
    common = "[" + ", ".join(q(n) for n in ci.COMMON_NAMES) + "]"
    names = "doi_score journal_score year_score author_score title_score template_score probability"
    out["reference_scores"] = f"""WITH {_references()}, f AS (SELECT doc_id, entry_index, entry, {_fields('entry')} FROM entries), g AS (SELECT *, lower(journal) AS j, substring(year, 1, 4)::INT AS y FROM f),
s AS (SELECT doc_id, entry_index, CASE WHEN doi IS NULL THEN 0.25 ELSE 0 END::DOUBLE AS doi_score,
 CASE WHEN j = '' THEN 0.15 WHEN {has('j', ci.KNOWN_JOURNALS)} THEN 0 WHEN {has('j', ci.KNOWN_PUBLISHERS)} THEN 0.05 WHEN {has('j', ci.TEMPLATE_WORDS)} THEN 0.3 ELSE 0.15 END::DOUBLE AS journal_score,
 CASE WHEN y IS NULL THEN 0.15 WHEN y < 1900 THEN 0.4 WHEN y > 2025 THEN 0.5 WHEN y >= 2023 THEN 0.05 ELSE 0 END::DOUBLE AS year_score,
 CASE WHEN len(author_list) = 0 THEN 0.2 WHEN len(author_list) >= 2 AND len(list_filter(author_list, lambda a: len(list_intersect(regexp_split_to_array(lower(a), '\\s+'), {common})) > 0)) = len(author_list) THEN 0.25 ELSE 0 END::DOUBLE AS author_score,
 CASE WHEN title = '' THEN 0.1 WHEN length(title) < 15 THEN 0.15 ELSE 0 END::DOUBLE AS title_score,
 CASE WHEN regexp_matches(entry, {q(ci.TEMPLATES[0])}) OR regexp_matches(entry, {q(ci.TEMPLATES[1])}) THEN 0.4 ELSE 0 END::DOUBLE AS template_score FROM g),
p AS (SELECT *, least(1.0, (doi_score + journal_score + year_score + author_score + title_score + template_score) / 1.5) AS probability FROM s)
SELECT doc_id, entry_index, {_round(names)}, CASE WHEN probability >= 0.65 THEN 'critical' WHEN probability >= 0.45 THEN 'high' WHEN probability >= 0.25 THEN 'medium' ELSE 'low' END AS risk FROM p"""

    ranges = [("latin", 0x41, 0x7A), ("cyrillic", 0x400, 0x4FF), ("arabic", 0x600, 0x6FF), ("hebrew", 0x590, 0x5FF), ("devanagari", 0x900, 0x97F), ("cjk", 0x4E00, 0x9FFF), ("hiragana", 0x3040, 0x309F), ("katakana", 0x30A0, 0x30FF), ("hangul", 0xAC00, 0xD7AF), ("thai", 0xE00, 0xE7F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("gujarati", 0xA80, 0xAFF), ("gurmukhi", 0xA00, 0xA7F)]
    case = " ".join(f"WHEN unicode(c) BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in ranges)
    script = f"""letters AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS c FROM (SELECT doc_id, regexp_extract_all(text, '\\p{{L}}') AS l FROM documents)),
byscript AS (SELECT doc_id, CASE {case} ELSE 'other' END AS script, count(*) AS k, min(n) AS first FROM letters GROUP BY ALL),
best AS (SELECT doc_id, arg_max(script, k * 100000000 - first) AS script FROM byscript GROUP BY doc_id)"""
    out["script_detect"] = f"WITH {script} SELECT d.doc_id, coalesce(script, 'unknown') AS script FROM documents d LEFT JOIN best USING (doc_id)"
    arabic = {k: "len(list_intersect(ws, [" + ", ".join(q(w) for w in v) + "]))" for k, v in ARABIC_SCRIPT.items()}
    latin = {k: " + ".join(f"((length(p) - length(replace(p, {q(' ' + w + ' ')}, ''))) // {len(w) + 2})" for w in v) for k, v in LATIN_SCRIPT.items()}
    names_case = "CASE detected " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE detected END"
    latin_select = ", ".join(f"({v}) AS l_{k}" for k, v in latin.items())
    latin_top = "greatest(" + ", ".join(f"l_{k}" for k in latin) + ")"
    latin_case = "CASE WHEN " + latin_top + " = 0 THEN 'en' " + " ".join(f"WHEN l_{k} = {latin_top} THEN '{k}'" for k in latin) + " END"
    detect = f"""{script}, scored AS (SELECT d.doc_id, d.lang, coalesce(script, 'unknown') AS script, {arabic['ur']} AS ur, {arabic['ar']} AS ar, {arabic['fa']} AS fa, {latin_select}
 FROM (SELECT doc_id, lang, {pcs('text')} AS ws, ' ' || lower(text) || ' ' AS p FROM {DOCS}) d LEFT JOIN best USING (doc_id)),
found AS (SELECT doc_id, lang, CASE script WHEN 'arabic' THEN CASE WHEN ur >= ar AND ur >= fa AND ur > 0 THEN 'ur' WHEN ar >= fa AND ar > 0 THEN 'ar' WHEN fa > 0 THEN 'fa' ELSE 'ur' END
 WHEN 'latin' THEN {latin_case} WHEN 'cyrillic' THEN 'ru' WHEN 'hebrew' THEN 'he' WHEN 'devanagari' THEN 'hi' WHEN 'cjk' THEN 'zh' WHEN 'hiragana' THEN 'ja' WHEN 'katakana' THEN 'ja' WHEN 'hangul' THEN 'ko'
 WHEN 'thai' THEN 'th' WHEN 'bengali' THEN 'bn' WHEN 'tamil' THEN 'ta' WHEN 'telugu' THEN 'te' WHEN 'gujarati' THEN 'gu' WHEN 'gurmukhi' THEN 'pa' ELSE 'unknown' END AS detected FROM scored)"""
    out["language_detect"] = f"WITH {detect} SELECT doc_id, detected, {names_case} AS name FROM found"
    out["lang_agreement"] = f"WITH {detect} SELECT lang AS labelled, detected, count(*) AS n FROM found GROUP BY ALL"

    sets = f"s AS (SELECT doc_id, list_distinct({grams('w', 5)}) AS g FROM (SELECT doc_id, {toks('text')} AS w FROM {DOCS})), f AS (SELECT doc_id, g, md5(array_to_string(list_sort(g), '|')) AS k FROM s WHERE len(g) > 0)"
    out["jaccard5_classes"] = f"WITH {sets} SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM f"
    out["jaccard5_pairs"] = f"""WITH {sets}, c AS (SELECT min(doc_id) AS id, any_value(g) AS g FROM f GROUP BY k), e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.id AS class_a, b.id AS class_b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT class_a, class_b, shared, round(shared::DOUBLE / (na + nb - shared), 6) AS jaccard FROM p WHERE shared::DOUBLE / (na + nb - shared) >= 0.8"""
    out["containment5_sources"] = f"""WITH a AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM (SELECT doc_id, list_distinct({grams('w', 5)}) AS g FROM (SELECT doc_id, {toks('text')} AS w FROM {DOCS}))),
b AS (SELECT source_key, len(g) AS n, unnest(g) AS x FROM (SELECT source_key, list_distinct({grams('w', 5)}) AS g FROM (SELECT source_key, {toks('text')} AS w FROM source_items)))
SELECT doc_id, source_key, count(*) AS shared, round(count(*)::DOUBLE / (a.n + b.n - count(*)), 6) AS jaccard, round(count(*)::DOUBLE / a.n, 6) AS containment FROM a JOIN b USING (x) GROUP BY doc_id, source_key, a.n, b.n"""
    runs = f"""a AS (SELECT doc_id, unnest(range(len(g))) AS pa, unnest(g) AS x FROM (SELECT doc_id, {grams('w', 8)} AS g FROM (SELECT doc_id, {toks('text')} AS w FROM {DOCS}))),
b AS (SELECT source_key, unnest(range(len(g))) AS pb, unnest(g) AS x FROM (SELECT source_key, {grams('w', 8)} AS g FROM (SELECT source_key, {toks('text')} AS w FROM source_items))),
m AS (SELECT doc_id, source_key, pa, pb, pb - pa AS d, pa - row_number() OVER (PARTITION BY doc_id, source_key, pb - pa ORDER BY pa) AS i FROM a JOIN b USING (x)),
runs AS (SELECT doc_id, source_key, min(pa) AS start_a, min(pb) AS start_b, count(*) + 7 AS length FROM m GROUP BY doc_id, source_key, d, i)"""
    out["exact_spans8"] = f"WITH {runs} SELECT doc_id, source_key, start_a, start_b, length FROM runs"
    out["longest_span"] = f"WITH {runs} SELECT doc_id, source_key, start_a, start_b, length FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start_a + length DESC, start_b + length DESC, source_key) = 1"

    ca, cb = minhash_constants()
    perms = f"perms AS (SELECT unnest(range(128)) AS k, unnest({[int(x) for x in ca]}::HUGEINT[]) AS a, unnest({[int(x) for x in cb]}::HUGEINT[]) AS b)"
    wrap = "((a * h + b) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT"
    value = f"((({wrap}) % 2147483647) + 2147483647) % 2147483647"

    def signatures(src: str, ident: str, col: str, name: str) -> str:
        return f"""{name}_g AS (SELECT {ident} AS id, list_distinct({grams('w', 5)}) AS g FROM (SELECT {ident}, {toks(col)} AS w FROM {src})),
{name}_h AS (SELECT id, ({md5_64('unnest(g)')}::HUGEINT % 9223372036854775808::HUGEINT) AS h FROM {name}_g),
{name}_m AS (SELECT id, k, min({value})::BIGINT AS v FROM {name}_h CROSS JOIN perms GROUP BY id, k),
{name} AS (SELECT g.id, coalesce(s.sig, list_transform(range(128), lambda x: 9223372036854775807)) AS sig FROM {name}_g g LEFT JOIN (SELECT id, list(v ORDER BY k) AS sig FROM {name}_m GROUP BY id) s USING (id))"""

    out["minhash_signatures"] = f"WITH {perms}, {signatures(DOCS, 'doc_id', 'text', 'x')} SELECT id AS doc_id, array_to_string(sig, ',') AS signature FROM x"
    out["minhash_similarity"] = f"""WITH {perms}, {signatures(PAIRS, 'evidence_id', 'submitted_text', 'x')}, {signatures(PAIRS, 'evidence_id', 'source_text', 'y')}
SELECT x.id AS evidence_id, round(len(list_filter(range(1, 129), lambda i: x.sig[i] = y.sig[i])) / 128.0, 6)::DOUBLE AS similarity FROM x JOIN y USING (id)"""

    def votes(src: str, ident: str, col: str, name: str) -> str:
        return f"""{name}_g AS (SELECT {ident} AS id, unnest({grams('w', 3)}) AS g FROM (SELECT {ident}, {toks(f"coalesce({col}, '')")} AS w FROM {src})),
{name}_b AS (SELECT id, b, sum(CASE WHEN ({md5_64('g')} >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM {name}_g CROSS JOIN (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY id, b),
{name}_s AS (SELECT id, sum(CASE WHEN v > 0 THEN CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << b::INT) END ELSE 0 END)::BIGINT AS h FROM {name}_b GROUP BY id),
{name} AS (SELECT d.{ident} AS id, coalesce(h, 0)::BIGINT AS h FROM {src} d LEFT JOIN {name}_s s ON s.id = d.{ident})"""

    out["simhash"] = f"WITH {votes('documents', 'doc_id', 'text', 'x')} SELECT id AS doc_id, h AS simhash FROM x"
    out["simhash_similarity"] = f"WITH {votes(PAIRS, 'evidence_id', 'submitted_text', 'x')}, {votes(PAIRS, 'evidence_id', 'source_text', 'y')} SELECT x.id AS evidence_id, round(1 - bit_count(xor(x.h, y.h)) / 64.0, 6)::DOUBLE AS similarity FROM x JOIN y USING (id)"
    out["simhash_pairs"] = f"WITH {votes('documents', 'doc_id', 'text', 'x')}, c AS (SELECT h, min(id) AS id FROM x GROUP BY h) SELECT p.id AS a, r.id AS b, bit_count(xor(p.h, r.h))::BIGINT AS distance FROM c p JOIN c r ON p.id < r.id WHERE bit_count(xor(p.h, r.h)) <= 9"
    term = lambda c: f"list_filter({toks(c)}, lambda x: length(x) >= 2)"
    both = lambda c: f"list_concat(w, {grams('w', 2)}) FROM (SELECT evidence_id, {term(c)} AS w FROM {PAIRS})"
    out["tfidf_cosine"] = f"""WITH a AS (SELECT evidence_id, t, count(*) AS n FROM (SELECT evidence_id, unnest(x) AS t FROM (SELECT evidence_id, {both('submitted_text').replace(' FROM', ' AS x FROM', 1)})) GROUP BY ALL),
b AS (SELECT evidence_id, t, count(*) AS n FROM (SELECT evidence_id, unnest(x) AS t FROM (SELECT evidence_id, {both('source_text').replace(' FROM', ' AS x FROM', 1)})) GROUP BY ALL),
j AS (SELECT coalesce(a.evidence_id, b.evidence_id) AS id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.evidence_id = b.evidence_id AND a.t = b.t),
s AS (SELECT id, sum(x * y)::DOUBLE AS d, sum(pow(x * CASE WHEN x > 0 AND y > 0 THEN 1 ELSE ln(1.5) + 1 END, 2)) AS p, sum(pow(y * CASE WHEN x > 0 AND y > 0 THEN 1 ELSE ln(1.5) + 1 END, 2)) AS r FROM j GROUP BY id)
SELECT e.evidence_id, round(coalesce(CASE WHEN p > 0 AND r > 0 THEN d / sqrt(p * r) ELSE 0 END, 0), 6)::DOUBLE AS tfidf_cosine FROM {PAIRS} e LEFT JOIN s ON s.id = e.evidence_id"""
    out["levenshtein_ratio"] = "SELECT p_partkey, round(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1 ELSE 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) END, 6) AS ratio FROM part"
    start = "CASE WHEN substring(p_name, 1, 1) <> substring(p_type, 1, 1) THEN 0 WHEN substring(p_name, 1, 2) <> substring(p_type, 1, 2) THEN 1 WHEN substring(p_name, 1, 3) <> substring(p_type, 1, 3) THEN 2 WHEN substring(p_name, 1, 4) <> substring(p_type, 1, 4) THEN 3 ELSE 4 END"
    out["jaro_winkler"] = f"SELECT p_partkey, round(j + {start} * 0.1::DOUBLE * (1 - j), 6) AS score FROM (SELECT *, jaro_similarity(p_name, p_type) AS j FROM part)"

    score = dot("q.embedding", "v.embedding")
    near = f"near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {score} AS score, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"
    out["knn_batch"] = f"WITH {near} SELECT query_id, id, round(score, 6) AS score, rank FROM near WHERE rank <= 10"
    out["source_discovery"] = f"WITH {near} SELECT query_id, id, round(score, 6) AS score, rank FROM near WHERE rank <= 10 AND score >= 0.40"
    out["semantic_best_match"] = f"WITH {near} SELECT query_id, id, round(score, 6) AS score, label::BIGINT AS label FROM near WHERE rank = 1 AND score >= 0.2"
    pair = f"SELECT q.vec_id AS a, v.vec_id AS b, {score} AS score, q.label AS la, v.label AS lb FROM embeddings q JOIN embeddings v ON q.vec_id < v.vec_id"
    out["batch_pairs"] = f"SELECT a, b, round(score, 6) AS score FROM ({pair}) WHERE score >= 0.40"
    out["batch_clusters"] = f"""WITH RECURSIVE e AS (SELECT a, b FROM ({pair}) WHERE score >= 0.40), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, other) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a) SELECT node, min(other) AS component FROM r GROUP BY node"""
    out["collusion_edges"] = f"SELECT least(la, lb)::BIGINT AS a, greatest(la, lb)::BIGINT AS b, count(*) AS shared, round(avg(score), 6) AS mean_score FROM ({pair}) WHERE score >= 0.35 AND la <> lb GROUP BY 1, 2 HAVING count(*) >= 2"

    out["compare_documents"] = f"SELECT q.label::BIGINT AS a, v.label::BIGINT AS b, q.vec_id AS vec_a, v.vec_id AS vec_b, round({score}, 6) AS score FROM embeddings q JOIN embeddings v ON q.label % 100 = 0 AND v.label <> q.label QUALIFY row_number() OVER (PARTITION BY q.label, v.label, q.vec_id ORDER BY {score} DESC, v.vec_id) = 1 AND {score} >= 0.30"
    out["vectors_of_documents"] = "SELECT label::BIGINT AS doc_id, count(*) AS vectors, min(vec_id) AS first_id, min(len(embedding)) AS width FROM embeddings GROUP BY label"
    kept = f"kept AS (SELECT doc_id, paragraph_index, any_value(text) AS text FROM paragraphs WHERE NOT coalesce(is_reference, false) AND len({pcs("coalesce(text, '')")}) >= 10 GROUP BY ALL)"
    out["paragraph_chunks"] = f"""WITH {kept}, t AS (SELECT doc_id, paragraph_index, {pcs('text')} AS w FROM kept UNION ALL SELECT doc_id, -1, {pcs('text')} FROM {DOCS} WHERE doc_id NOT IN (SELECT doc_id FROM kept)),
c AS (SELECT doc_id, paragraph_index, w, unnest(CASE WHEN len(w) > 200 THEN range(1, len(w) + 1, 160) ELSE [1] END) AS i FROM t WHERE len(w) > 0), p AS (SELECT doc_id, paragraph_index, i, list_slice(w, i, i + 199) AS c FROM c)
SELECT doc_id, paragraph_index::BIGINT AS paragraph_index, row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY i) - 1 AS sub_index, array_to_string(c, ' ') AS chunk FROM p WHERE i = 1 OR len(c) >= 20"""
    terms = {"artificial intelligence": "ai", "machine learning": "ml", "deep learning": "dl", "neural network": "nn", "natural language processing": "nlp"}
    times = lambda w: f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}"
    out["term_variance"] = f"WITH added AS (SELECT doc_id, text FROM {DOCS} UNION ALL SELECT * FROM (VALUES {values_sql()}) v(doc_id, text) WHERE doc_id NOT IN (SELECT doc_id FROM documents)) " + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, '{x}' AS short, {times(t)} AS term_count, {times(x)} AS short_count FROM added WHERE {times(t)} >= 3 AND {times(x)} >= 3" for t, x in terms.items())
    terms_of = lambda src, key, c: f"(SELECT {key} AS id, unnest(list_concat(w, {grams('w', 2)})) AS t FROM (SELECT {key}, {term(c)} AS w FROM {src}))"
    out["tfidf_fitted"] = f"""WITH c AS (SELECT id, t, count(*) AS n FROM {terms_of(DOCS, 'doc_id', 'text')} GROUP BY ALL), v AS (SELECT t, ln((1 + (SELECT count(*) FROM {DOCS}))::DOUBLE / (1 + count(*))) + 1 AS idf FROM c GROUP BY t ORDER BY sum(n) DESC, t LIMIT 10000),
a AS (SELECT id, t, count(*) * any_value(idf) AS x FROM {terms_of(PAIRS, 'evidence_id', 'submitted_text')} JOIN v USING (t) GROUP BY id, t), b AS (SELECT id, t, count(*) * any_value(idf) AS y FROM {terms_of(PAIRS, 'evidence_id', 'source_text')} JOIN v USING (t) GROUP BY id, t),
d AS (SELECT id, sum(x * y) AS d FROM a JOIN b USING (id, t) GROUP BY id), p AS (SELECT id, sum(x * x) AS p FROM a GROUP BY id), r AS (SELECT id, sum(y * y) AS r FROM b GROUP BY id)
SELECT evidence_id, round(coalesce(d / sqrt(p * r), 0), 6)::DOUBLE AS tfidf FROM {PAIRS} e LEFT JOIN d ON d.id = evidence_id LEFT JOIN p ON p.id = evidence_id LEFT JOIN r ON r.id = evidence_id"""
    flat = f"regexp_replace(text, '{W}+', ' ', 'g')"
    out["document_sentences"] = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({flat}, '([.!?]) +([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: {trim('x')}), lambda x: length(x) > 20) AS s FROM {DOCS})
SELECT doc_id, unnest(range(len(s))) AS sentence_index, unnest(s) AS sentence FROM p"""
    out["shown_findings"] = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['critical', 'high', 'medium'], severity), confidence DESC NULLS LAST, finding_id) AS rank, finding_id, severity, round(confidence, 6) AS confidence FROM {FINDINGS} WHERE severity IN ('critical', 'high', 'medium')"
    out["shown_evidence"] = "SELECT evidence_id, substring(submitted_text, 1, 300) AS submitted_text, substring(source_text, 1, 300) AS source_text, round(similarity, 4) AS similarity FROM evidence"

    out["overlap_scores"] = f"""SELECT evidence_id, m.similarity AS minhash, s.similarity AS simhash, t.tfidf_cosine AS tfidf, j.jaccard, round(greatest(m.similarity, s.similarity, t.tfidf_cosine, j.jaccard), 6) AS overall FROM ({out['minhash_similarity']}) m JOIN ({out['simhash_similarity']}) s USING (evidence_id) JOIN ({out['tfidf_cosine']}) t USING (evidence_id)
JOIN (SELECT evidence_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS jaccard FROM (SELECT evidence_id, list_distinct({grams('a', 5)}) AS x, list_distinct({grams('b', 5)}) AS y FROM (SELECT evidence_id, {toks('submitted_text')} AS a, {toks('source_text')} AS b FROM {PAIRS}))) j USING (evidence_id)"""
    syn = "MAP {" + ", ".join(f"{q(w)}: [{', '.join(q(y) for y in s)}]" for w, s in pa.synonym_map().items()) + "}"
    synd = lambda a, b: f"(CASE WHEN len({toks(a)}) = 0 OR len({toks(b)}) = 0 THEN 0.0 ELSE len(list_filter(list_distinct({toks(b)}), lambda w: len(list_intersect(syn[w], {toks(a)})) > 0))::DOUBLE / len(list_distinct({toks(b)})) END)"
    base = f"e AS (SELECT evidence_id, source_text AS a, submitted_text AS b, {syn} AS syn FROM {PAIRS})"
    out["synonym_density"] = f"WITH {base} SELECT evidence_id, round({synd('a', 'b')}, 6) AS density FROM e"
    pas, act = lambda c: f"regexp_matches({c}, {q(whole(pa.PASSIVE))})", lambda c: f"(regexp_matches({c}, {q(whole(pa.ACTIVE[0]))}) OR regexp_matches({c}, {q(whole(pa.ACTIVE[1]))}))"
    changed = f"(({pas('a')} AND {act('b')}) OR ({act('a')} AND {pas('b')}))"
    out["voice_change"] = f"WITH {base} SELECT evidence_id, {pas('b')} AS passive, {act('b')} AS active, {changed} AS changed FROM e"
    verbs = pa.VERB_NOUN
    either = " + ".join(f"greatest(regexp_matches(lower(a), {q(whole(chr(92) + "b" + v))})::INT, regexp_matches(lower(b), {q(whole(chr(92) + "b" + n))})::INT)" for v, n in verbs)
    twice = " + ".join(f"regexp_matches(lower(a), {q(whole(chr(92) + "b" + v))})::INT * regexp_matches(lower(b), {q(whole(chr(92) + "b" + n))})::INT" for v, n in verbs)
    nom = f"(CASE WHEN ({either}) = 0 THEN 0.0 ELSE ({twice})::DOUBLE / ({either}) END)"
    out["nominalization"] = f"WITH {base} SELECT evidence_id, round({nom}, 6) AS score FROM e"
    place = lambda x, y: f"list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_contains({y}, {x}[i]) THEN i - 1 ELSE -1 END), lambda i: i >= 0)"
    order = f"""words AS (SELECT evidence_id, {toks('a')} AS x, {toks('b')} AS y FROM e), places AS (SELECT evidence_id, {place('x', 'y')} AS p, {place('y', 'x')} AS r FROM words),
cut AS (SELECT evidence_id, least(len(p), len(r)) AS n, list_slice(p, 1, least(len(p), len(r))) AS p, list_slice(r, 1, least(len(p), len(r))) AS r FROM places),
orders AS (SELECT evidence_id, CASE WHEN n < 2 THEN 0.0 ELSE list_sum(list_transform(range(1, n + 1), lambda i: abs(p[i]::DOUBLE / CASE WHEN list_max(p) = 0 THEN 1 ELSE list_max(p) END - r[i]::DOUBLE / CASE WHEN list_max(r) = 0 THEN 1 ELSE list_max(r) END))) / n END AS change FROM cut)"""
    out["word_order"] = f"WITH {base}, {order} SELECT evidence_id, round(change, 6) AS change FROM orders"
    classes = " ".join(f"WHEN w IN ({', '.join(q(x) for x in ws)}) THEN '{c}'" for c, ws in pa.CLASSES)
    letter = f"CASE {classes} WHEN ends_with(w, 'ly') THEN 'A' WHEN ends_with(w, 'ing') OR ends_with(w, 'ed') THEN 'V' WHEN ends_with(w, 'tion') OR ends_with(w, 'ment') OR ends_with(w, 'ness') THEN 'N' WHEN length(w) > 3 THEN 'W' ELSE 'S' END"
    code = lambda c: f"array_to_string(list_transform(list_slice({toks(c)}, 1, 30), lambda w: {letter}), '')"
    structure = f"codes AS (SELECT evidence_id, {code('a')} AS code_a, {code('b')} AS code_b FROM e), structures AS (SELECT *, CASE WHEN code_a = '' OR code_b = '' THEN 0.0 ELSE 1 - levenshtein(code_a, code_b)::DOUBLE / greatest(length(code_a), length(code_b)) END AS similarity FROM codes)"
    out["structure_similarity"] = f"WITH {base}, {structure} SELECT evidence_id, code_a, code_b, round(similarity, 6) AS similarity FROM structures"
    out["paraphrase_score"] = f"WITH {base}, {order}, {structure} SELECT evidence_id, round(0.35::DOUBLE * {synd('a', 'b')} + 0.2::DOUBLE * {changed}::INT + 0.15::DOUBLE * {nom} + 0.15::DOUBLE * similarity + 0.15::DOUBLE * change, 6) AS score FROM e JOIN orders USING (evidence_id) JOIN structures USING (evidence_id)"

    phrases = " + ".join(f"contains(lower(t), {q(p)})::INT" for p in wr.PHRASES)
    marks = " + ".join(f"contains(t, {q(m)})::INT" for m in wr.MARKS)
    high = " + ".join(f"({n}_score >= {wr.CUTS[n][0]}::DOUBLE)::INT" for n in wr.WEIGHTS)
    low = " + ".join(f"({n}_score < {wr.CUTS[n][1]}::DOUBLE)::INT" for n in wr.WEIGHTS)
    overall = " + ".join(f"{n}_score * {w}::DOUBLE" for n, w in wr.WEIGHTS.items())
    out["writing_signals"] = f"""WITH base AS (SELECT doc_id, t, {toks('t')} AS w, {style_sents('t')} AS s, len({pcs('t')}) AS words FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
bi AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest({grams('w', 2)}) AS g FROM base) GROUP BY ALL),
ent AS (SELECT doc_id, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(greatest(sum(c), 2)) AS entropy FROM bi GROUP BY doc_id),
st AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(s, lambda y: lower(array_to_string(list_slice({pcs('y')}, 1, 2), ' ')))) AS x FROM base) GROUP BY ALL),
tops AS (SELECT doc_id, max(c)::DOUBLE / sum(c) AS top_start FROM st GROUP BY doc_id),
f AS (SELECT doc_id, words, len(w) AS n, len(s) AS k, length(t) AS chars, list_transform(s, lambda x: len({pcs('x')})) AS l, CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / len(w) END AS ttr, {phrases} AS phrases, {marks} AS marks FROM base),
g AS (SELECT *, CASE WHEN k > 0 THEN (sqrt((k * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l))::DOUBLE) / k) / (list_sum(l)::DOUBLE / k) END AS cv FROM f LEFT JOIN ent USING (doc_id) LEFT JOIN tops USING (doc_id)),
h AS (SELECT doc_id, words, entropy, cv, ttr, top_start, phrases, marks, CASE WHEN n >= 20 THEN {unit('1 - entropy * 2')} ELSE 0.0 END::DOUBLE AS perplexity_score, CASE WHEN k >= 5 THEN {unit('1 - cv * 1.8::DOUBLE')} ELSE 0.0 END::DOUBLE AS burstiness_score,
 CASE WHEN n >= 30 THEN {unit('1 - (ttr - 0.35::DOUBLE) * 2.5::DOUBLE')} ELSE 0.0 END::DOUBLE AS vocabulary_score, CASE WHEN k >= 5 THEN {unit('top_start * 2 - 0.3::DOUBLE')} ELSE 0.0 END::DOUBLE AS uniformity_score,
 CASE WHEN words >= 20 THEN {unit('phrases / greatest(words / 100.0::DOUBLE, 1.0) / 4')} ELSE 0.0 END::DOUBLE AS phrases_score, CASE WHEN chars < 100 THEN 0.0 WHEN marks = 0 THEN 0.5 ELSE {unit('1 - marks / 8.0::DOUBLE')} END::DOUBLE AS punctuation_score FROM g),
i AS (SELECT *, CASE WHEN words >= 30 THEN {overall} ELSE 0.0 END::DOUBLE AS overall, {high} AS hi, {low} AS lo FROM h)
SELECT doc_id, words, phrases::BIGINT AS phrases, marks::BIGINT AS marks, {_round('cv ttr entropy top_start perplexity_score burstiness_score vocabulary_score uniformity_score phrases_score punctuation_score overall')},
CASE WHEN words < 30 OR (hi >= 2 AND lo >= 2) THEN 'INCONCLUSIVE' WHEN overall >= 0.65 AND hi >= 4 THEN 'HIGH' WHEN overall >= 0.5 AND hi >= 3 THEN 'MEDIUM' WHEN overall >= 0.35 THEN 'LOW' ELSE 'INCONCLUSIVE' END AS level FROM i"""
    tool = ", ".join(f"struct_pack(tool := '{t}', hits := {' + '.join(f'len(regexp_extract_all(t, {q(p)}))' for p in ps)})" for t, ps in wr.TOOLS.items())
    generic = " + ".join(f"regexp_matches(t, {q(p)})::INT" for p in wr.STYLE_PATTERNS)
    out["tool_marks"] = f"""WITH added AS (SELECT doc_id, text FROM {DOCS} UNION ALL SELECT * FROM (VALUES {values_sql()}) v(doc_id, text) WHERE doc_id NOT IN (SELECT doc_id FROM documents)), l AS (SELECT doc_id, lower(text) AS t FROM added WHERE len({pcs('text')}) >= 30), r AS (SELECT doc_id, unnest([{tool}, struct_pack(tool := 'generic_style', hits := ({generic})::BIGINT)]) AS x FROM l), h AS (SELECT doc_id, x.tool AS tool, x.hits AS hits FROM r WHERE x.hits > 0)
SELECT doc_id, tool, hits, round(least(1.0, hits / CASE WHEN tool = 'generic_style' THEN 4.0 ELSE 5.0 END), 6)::DOUBLE AS score, CASE WHEN tool = 'generic_style' THEN CASE WHEN hits >= 2 THEN 'medium' ELSE 'weak' END WHEN hits >= 4 THEN 'strong' WHEN hits >= 2 THEN 'medium' ELSE 'weak' END AS strength FROM h"""
    out["style_fingerprint"] = f"WITH {_prints()} SELECT doc_id, {_round('sentence_length sentence_deviation richness punctuation function_words word_length readability complexity')}, word_count, sentence_count FROM prints"
    diff = " + ".join(f"abs(p.{n} - m.{n}) * {s!r}::DOUBLE" for n, s in wr.SCALES.items())
    means = ", ".join(f"avg({n}) AS {n}" for n in wr.SCALES)
    out["style_deviation"] = f"WITH {_prints()}, p AS (SELECT prints.*, author_key FROM prints JOIN documents USING (doc_id) WHERE text IS NOT NULL AND author_key IS NOT NULL), m AS (SELECT author_key, {means} FROM p GROUP BY author_key) SELECT doc_id, author_key, round(({diff}) / 8, 6) AS deviation FROM p JOIN m USING (author_key)"
    out["common_phrases"] = f"WITH t AS (SELECT doc_id, {grams('w', 3)} AS g FROM (SELECT doc_id, {toks('text')} AS w FROM {DOCS})), x AS (SELECT doc_id, unnest(range(len(g))) AS n, unnest(g) AS phrase FROM t), c AS (SELECT doc_id, phrase, count(*) AS times, min(n) AS place FROM x GROUP BY doc_id, phrase HAVING count(*) >= 2) SELECT doc_id, phrase, times FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, place) <= 5"
    out["repeated_blocks"] = rf"""WITH b AS (SELECT doc_id, {trim('b')} AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM {DOCS})),
k AS (SELECT doc_id, b, CASE WHEN length(b) > 80 THEN 'paragraph' WHEN len({pcs('b')}) BETWEEN 3 AND 10 AND regexp_matches(b, '^\p{{Lu}}') AND NOT ends_with(b, '.') THEN 'heading' END AS kind FROM b)
SELECT doc_id, kind, CASE WHEN kind = 'paragraph' THEN regexp_replace(lower(b), '{W}+', ' ', 'g') ELSE lower(b) END AS block, count(*) AS times FROM k WHERE kind IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"""
    inner = W[1:-1]
    out["web_queries"] = rf"""WITH f AS (SELECT doc_id, regexp_replace(text, '{W}+', ' ', 'g') AS t FROM {DOCS}), p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]){W}+', '\1' || chr(2), 'g'), chr(2)) AS s FROM f),
x AS (SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS s FROM p), y AS (SELECT *, regexp_replace(s, '^[{inner}"'']+|[{inner}"'']+$', '', 'g') AS qq FROM x WHERE length(s) BETWEEN 40 AND 200),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, lower(substring(qq, 1, 80)) ORDER BY length(s) DESC, n) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, n) AS rank FROM z)
SELECT doc_id, rank, substring(qq, 1, 150) AS query FROM r WHERE rank <= 3"""
    out["evidence_domains"] = r"SELECT regexp_extract(source_document, '^(?:web:)?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS domain, count(*) AS n FROM evidence WHERE source_document LIKE 'web:%' GROUP BY 1"
    out["html_text"] = rf"SELECT source_key, {trim(rf'''regexp_replace(title || ' ' || text || ' & more', '{W}+', ' ', 'g')''')} AS text FROM source_items"
    out["store_upsert_latest"] = f"SELECT finding_id, doc_id, finding_type, severity, round(confidence, 6) AS confidence FROM {FINDINGS}"
    out["latest_runs"] = f"SELECT agent, status, count(*) AS runs, sum(findings_count)::BIGINT AS findings, round(avg(duration_seconds), 6) AS mean_seconds FROM {_latest('agent_runs', 'run_id', 'created_at DESC NULLS LAST, loaded_at DESC NULLS LAST')} GROUP BY agent, status"
    out["store_stats"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("documents", "findings", "agent_runs"))
    out["store_cascade_delete"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t} WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE text IS NULL)" for t in ("documents", "findings", "agent_runs", "evidence"))
    over = {"exact_copy": "exact_overlap", "semantic_similarity": "semantic_overlap", "paraphrase": "paraphrase_overlap", "cross_language": "cross_language_overlap", "self_plagiarism": "self_overlap", "style_deviation": "style_deviation"}
    best = ", ".join(f"round(coalesce(max(c) FILTER (WHERE k = '{k}'), 0), 6)::DOUBLE AS {n}" for k, n in over.items())
    mean = " + ".join(f"coalesce(max(c) FILTER (WHERE k = '{k}'), 0)" for k in ("exact_copy", "semantic_similarity", "paraphrase", "self_plagiarism"))
    out["fusion_report"] = f"""WITH p AS (SELECT finding_id, count(*) AS pieces FROM evidence GROUP BY finding_id),
r AS (SELECT f.*, coalesce(p.pieces, 0) AS n, finding_type AS k, coalesce(confidence, 0) AS c, json_extract_string(metadata, '$.overall_level') AS lvl, contains(lower(title), 'missing') AS miss FROM {FINDINGS} f LEFT JOIN p USING (finding_id)),
g AS (SELECT doc_id, {best}, coalesce(max(n) FILTER (WHERE k = 'source_match'), 0) AS source_matches,
 coalesce(max(greatest(n, 1)) FILTER (WHERE k = 'citation_issue' AND miss), 0) + count(*) FILTER (WHERE k = 'citation_issue' AND NOT miss) AS citation_issues,
 coalesce(max(n) FILTER (WHERE k = 'fake_citation'), 0) AS reference_issues, coalesce(arg_max(lvl, (created_at, finding_id)) FILTER (WHERE k = 'ai_writing' AND lvl IN ('HIGH', 'MEDIUM', 'LOW')), 'INCONCLUSIVE') AS ai_writing_signal,
 coalesce(max(json_array_length(metadata, '$.clusters')) FILTER (WHERE k = 'collusion'), 0)::BIGINT AS collusion_clusters,
 count(*) AS findings, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_findings, ({mean}) / 4 AS mean FROM r GROUP BY doc_id)
SELECT * EXCLUDE (mean), CASE WHEN mean >= 0.6 THEN 'HIGH' WHEN mean >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS overall_confidence, (high_findings > 0 OR mean >= 0.6) AS human_review FROM g"""
    out["findings_by_type"] = f"SELECT finding_type, severity, count(*) AS findings, count(DISTINCT doc_id) AS documents, round(sum(confidence::DECIMAL(18, 9))::DOUBLE / count(confidence), 6) AS mean_confidence FROM {FINDINGS} GROUP BY ALL"
    out["top_evidence"] = "SELECT finding_id, row_number() OVER (PARTITION BY finding_id ORDER BY similarity DESC NULLS LAST, evidence_id) AS rank, evidence_id, round(similarity, 6) AS similarity FROM evidence QUALIFY rank <= 3"
    out |= _detectors(out)
    return out


def _detectors(out: dict[str, str]) -> dict[str, str]:
    """Findings of the detectors that SQL can express, from the submitted documents and the added texts."""
    first = "WITH original AS (SELECT doc_id, text, doc_role, author_key FROM documents WHERE text IS NOT NULL), "
    submitted = f"SELECT doc_id, text, author_key FROM original WHERE doc_role = 'submitted' UNION ALL SELECT *, NULL FROM (VALUES {values_sql()}) v(doc_id, text)"
    long = f"len({pcs('text')}) >= 100"

    def of(name: str, sql: str, alias: str = "x") -> str:
        return f"{alias} AS (WITH documents AS ({submitted}) {'' if not sql.lstrip().startswith('WITH') else ', '}{sql.lstrip()[4:] if sql.lstrip().startswith('WITH') else sql})"

    def rows(kind: str, title: str, confidence: str, severity: str, evidence: str, pieces: str, metadata: str, rest: str) -> str:
        return f"SELECT '{kind}' AS finding_type, doc_id::BIGINT AS doc_id, NULL::BIGINT AS source_id, {title} AS title, round({confidence}, 6)::DOUBLE AS confidence, {severity} AS severity, {evidence} AS evidence, ({pieces})::BIGINT AS pieces, {metadata} AS metadata FROM {rest}"

    found = {}
    level = "CASE level WHEN 'HIGH' THEN {} WHEN 'MEDIUM' THEN {} ELSE {} END"
    found["detect_ai_writing"] = f"{first}{of('writing_signals', out['writing_signals'])} " + rows("ai_writing", "'Signals of generated writing'", level.format(0.75, 0.55, 0.5), level.format("'high'", "'medium'", "'info'"), "''", "0", """'{"overall_level":"' || level || '"}'""", "x WHERE words >= 50")
    tools = f"(SELECT DISTINCT ON (doc_id) doc_id, tool, score FROM x ORDER BY doc_id, score DESC, tool) WHERE score >= 0.3"
    found["detect_ai_tool"] = f"{first}{of('tool_marks', out['tool_marks'])} " + rows("ai_writing", "'Marks of a writing tool'", "score", "CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END", "tool", "1", "'{}'", tools)
    scored = "(SELECT doc_id, string_agg(left(entry, 300), ' | ' ORDER BY probability DESC, left(entry, 300)) FILTER (WHERE r <= 8) AS shown, least(8, count(*)) AS n, avg(probability) AS mean FROM (SELECT x.*, entry, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, left(entry, 300)) AS r FROM x JOIN y USING (doc_id, entry_index) WHERE risk <> 'low') GROUP BY doc_id)"
    found["detect_fake_reference"] = f"{first}{of('reference_scores', out['reference_scores'])}, {of('references_section', out['references_section'], 'y')} " + rows("fake_citation", "'References that may be made up'", "least(0.9, mean + 0.2)", "CASE WHEN mean >= 0.6 THEN 'high' WHEN mean >= 0.4 THEN 'medium' ELSE 'low' END", "shown", "n", "'{}'", scored)
    issues = "(SELECT doc_id, issue, array_to_string(list_transform(list_slice(list_sort(list(number)), 1, 8), lambda v: '[' || v || ']'), ' | ') AS shown, least(8, count(*)) AS n FROM x GROUP BY doc_id, issue)"
    by = lambda a, b, c: f"CASE issue WHEN 'missing_reference' THEN {a} WHEN 'unused_reference' THEN {b} ELSE {c} END"
    claims = "(SELECT doc_id, array_to_string(list_slice(list_sort(list(sentence)), 1, 5), ' | ') AS shown, least(5, count(*)) AS n FROM y GROUP BY doc_id)"
    found["detect_citation_integrity"] = (
        f"{first}{of('citation_issues', out['citation_issues'])}, {of('uncited_claims', out['uncited_claims'], 'y')} "
        + rows("citation_issue", by("'Citations with missing references'", "'References never cited'", "'References cited very often'"), by(0.95, 0.9, 0.55), by("'high'", "'low'", "'info'"), "shown", "n", "'{}'", issues)
        + " UNION ALL " + rows("citation_issue", "'Claims without a citation'", "0.65", "'medium'", "shown", "n", "'{}'", claims)
    )
    blocks = "(SELECT doc_id, kind, string_agg(b, ' | ' ORDER BY times DESC, b) FILTER (WHERE r <= 5) AS shown, least(5, count(*)) AS n FROM (SELECT doc_id, kind, left(block, 300) AS b, times, row_number() OVER (PARTITION BY doc_id, kind ORDER BY times DESC, left(block, 300)) AS r FROM x) GROUP BY doc_id, kind)"
    terms = "(SELECT doc_id, string_agg(term, ' | ' ORDER BY term, short) AS shown, count(*) AS n FROM z GROUP BY doc_id)"
    some = lambda kind: f"list_slice(list_sort(coalesce(list(number) FILTER (WHERE issue = '{kind}'), [])), 1, 10)"
    unmatched = f"(SELECT doc_id, {some('missing_reference')} AS a, {some('unused_reference')} AS b FROM y GROUP BY doc_id) WHERE len(a) + len(b) > 0"
    numbers = lambda c: f"'[' || array_to_string({c}, ',') || ']'"
    found["detect_research_integrity"] = (
        f"{first}{of('repeated_blocks', out['repeated_blocks'])}, {of('citation_issues', out['citation_issues'], 'y')}, {of('term_variance', out['term_variance'], 'z')} "
        + rows("research_integrity", "'Parts of the document are repeated'", "CASE kind WHEN 'paragraph' THEN 0.95 ELSE 0.85 END", "CASE kind WHEN 'paragraph' THEN 'medium' ELSE 'low' END", "shown", "n", "'{}'", blocks)
        + " UNION ALL " + rows("research_integrity", "'Terms and their short forms are mixed'", "0.55", "'low'", "shown", "n", "'{}'", terms)
        + " UNION ALL " + rows("research_integrity", "'Citations and references do not match'", "0.9", "'medium'", "''", "0", f"""'{{"numbers":{{"missing":' || {numbers('a')} || ',"unused":' || {numbers('b')} || '}}}}'""", unmatched)
    )
    diff = " + ".join(f"abs(x.{n} - m.{n}) * {s!r}::DOUBLE" for n, s in wr.SCALES.items())
    means = ", ".join(f"avg({n}) AS {n}" for n in wr.SCALES)
    prints = lambda docs: f"(WITH documents AS (SELECT * FROM ({docs}) WHERE {long}), {_prints()} SELECT prints.*, author_key FROM prints JOIN documents USING (doc_id))"
    deviating = f"(SELECT doc_id, ({diff}) / 8 AS d FROM x JOIN m USING (author_key)) WHERE d >= 0.15"
    found["detect_style_deviation"] = (
        f"{first}x AS {prints(submitted)}, y AS {prints("SELECT doc_id, text, author_key FROM original WHERE doc_role = 'history'")}, m AS (SELECT author_key, {means} FROM y GROUP BY author_key) "
        + rows("style_deviation", "'Style unlike the author''s earlier work'", "least(0.8, 2 * d)", "CASE WHEN d >= 0.3 THEN 'high' ELSE 'medium' END", "''", "0", "'{}'", deviating)
    )
    clusters = """(SELECT component AS doc_id, string_agg(a::VARCHAR, ' | ' ORDER BY r) FILTER (WHERE r <= 10) AS shown, least(10, count(*)) AS n, count(*) AS matches, max(sim) AS strength, any_value(members) AS members
 FROM (SELECT edges.*, component, members, row_number() OVER (PARTITION BY component ORDER BY sim DESC, a::VARCHAR, b::VARCHAR) AS r FROM edges JOIN nodes ON nodes.node = edges.a JOIN clustered USING (component)) GROUP BY component)"""
    found["detect_collusion"] = f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS s FROM (SELECT doc_id, {sents(clean('text'))} AS l FROM documents WHERE text IS NOT NULL AND doc_role = 'classroom')),
g AS (SELECT doc_id, n, list_sort(list_distinct({grams('w', 3)})) AS g FROM (SELECT doc_id, n, {toks('s')} AS w FROM s WHERE len({pcs('s')}) >= 8) WHERE len(w) >= 3),
d AS (SELECT doc_id, list_sort(list(g)) AS items FROM g GROUP BY doc_id), reps AS (SELECT doc_id, items, min(doc_id) OVER (PARTITION BY items) AS rep FROM d),
u AS (SELECT doc_id, n, len(g) AS size, unnest(g) AS gram FROM g WHERE doc_id IN (SELECT rep FROM reps)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*)::DOUBLE / (any_value(a.size) + any_value(b.size) - count(*)) AS j FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
same AS (SELECT doc_id, sum(c * c) AS shared FROM (SELECT doc_id, g, count(*) AS c FROM g GROUP BY ALL) GROUP BY doc_id),
edges AS (SELECT a, b, round(avg(j), 9) AS sim FROM p WHERE j >= 0.8 GROUP BY a, b HAVING count(*) >= 2 UNION ALL SELECT rep, doc_id, 1.0 FROM reps JOIN same USING (doc_id) WHERE doc_id <> rep AND shared >= 2),
ends AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), r(node, other) AS (SELECT a, a FROM ends UNION SELECT r.node, ends.b FROM r JOIN ends ON r.other = ends.a),
nodes AS (SELECT node, min(other) AS component FROM r GROUP BY node), clustered AS (SELECT component, list_sort(list(node)) AS members FROM nodes GROUP BY component)
""" + rows("collusion", "'Class documents share sentences'", "least(0.92, 0.6 + 0.05 * matches)", "CASE WHEN strength >= 0.85 THEN 'high' ELSE 'medium' END", "shown", "n", """'{"clusters":[[' || array_to_string(members, ',') || ']]}'""", clusters)
    return found
