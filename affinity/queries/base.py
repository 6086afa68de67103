"""What the queries over the documents share: the engine, and the named parts their SQL is put together from."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import SparkSession

from affinity.config import DEFAULT, LEGACY, EngineConfig
from affinity.functions.text import BLANKS, EXTENSIONS, STOPWORDS
from affinity.plans.related import RelatedEngine
from affinity.sources.corpus import document_corpus

#: The document that one-vs-all queries ask about, and the time that recency counts from.
QUERY = 51
NOW = datetime(2024, 11, 1)


def engine(spark: SparkSession, folder: str, config: EngineConfig = DEFAULT) -> RelatedEngine:
    """The engine of the queries; the ``_compat`` queries take the form with limits, see ``COMPAT_PARTS``."""
    return RelatedEngine(document_corpus(spark, folder), config, now=NOW)


def legacy_engine(spark: SparkSession, folder: str, config: EngineConfig = LEGACY) -> RelatedEngine:
    return RelatedEngine(document_corpus(spark, folder), config, legacy=True, now=NOW)


SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
OTHER = "[^" + SPACE[1:]
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}]"
CODE = r"`[^`]+`|```[\s\S]+?```"
SUFFIX = rf"(?i)\.({'|'.join(EXTENSIONS)})$"
STOPS = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def several(x: str, c: str) -> str:
    return f"(length({x}) - length(replace({x}, '{c}', '')))"


def url_sql(x: str) -> str:
    counts = " AND ".join(f"{several(x, c)} <= {n}" for c, n in (("+", 10), ("*", 10), (".", 50), ("/", 20), ("?", 10), ("#", 10)))
    return f"""(length({x}) BETWEEN 4 AND 2000 AND {counts} AND CASE
        WHEN starts_with({x}, 'https://') THEN length({x}) - 8 BETWEEN 1 AND 1499
        WHEN starts_with({x}, 'http://') THEN length({x}) - 7 BETWEEN 1 AND 1499
        WHEN starts_with({x}, 'file://') THEN length({x}) - 7 BETWEEN 1 AND 799
        ELSE regexp_matches({x}, '{SUFFIX}') AND length({x}) < 500 END)"""


def stem_sql(w: str) -> str:
    return f"""CASE
        WHEN regexp_matches({w}, '[/._-]') THEN {w}
        WHEN ends_with({w}, 'ing') AND length({w}) > 5 THEN {w}[:-4]
        WHEN ends_with({w}, 'ed') AND length({w}) > 4 THEN {w}[:-3]
        WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') AND length({w}) > 3 THEN {w}[:-2]
        WHEN ends_with({w}, 'ly') AND length({w}) > 4 THEN {w}[:-3]
        ELSE {w} END"""


def kept_sql(text: str, most: str) -> str:
    head = f"left({text}, {most} + 1)"
    return f"""CASE
        WHEN length({text}) <= {most} THEN length({text})
        WHEN length(regexp_extract({head}, '(?s)^(.*[.!?]{SPACE}+){OTHER}', 1)) > 0.8 * {most}
            THEN length(regexp_extract({head}, '(?s)^(.*[.!?]{SPACE}+){OTHER}', 1))
        WHEN length(regexp_extract({head}, '(?s)^(.*{OTHER}){SPACE}', 1)) > 0.9 * {most}
            THEN length(regexp_extract({head}, '(?s)^(.*{OTHER}){SPACE}', 1))
        ELSE greatest(least(length(regexp_extract({head}, '(?s)^(.*){SPACE}', 1)), {most}), floor(0.9 * {most})::BIGINT) END"""


def hash_sql(w: str) -> tuple[str, str, str]:
    """The three base hashes of a string without characters beyond the first plane."""
    codes = f"list_transform(string_split({w}, ''), lambda ch: unicode(ch)::BIGINT)"

    def fold(seed: int, step: str) -> str:
        return f"CASE WHEN {w} = '' THEN {seed} ELSE list_reduce({codes}, lambda h, c: {step}, {seed}::BIGINT) END"

    return (
        fold(2166136261, "(xor(h, c) * 16777619) & 4294967295"),
        fold(5381, "(h * 33 + c) & 4294967295"),
        fold(0, "(c + h * 65599) & 4294967295"),
    )


def seeded_sql(*parts: str, seed: int = 0) -> str:
    return hash_sql(f"concat_ws('|', '{seed}', {', '.join(f'{p}::VARCHAR' for p in parts)})")[0]


def score_sql(a: str, b: str, both: str, m: str, k: str) -> str:
    def n(t: str) -> str:
        return f"(-({m} / {k}::DOUBLE) * ln(1 - ({t}) / {m}::DOUBLE))"

    union = f"({a} + {b} - {both})"
    return f"""round(CASE WHEN least({a}, {b}) < 5 OR {union} >= {m} OR {union} <= 0 THEN 0.0
        ELSE least(1.0, greatest(0.0, ({n(a)} + {n(b)} - {n(union)}) / {n(union)})) END, 6)"""


def token_parts(name: str, source: str, key: str, text: str) -> dict[str, str]:
    """The steps that make ``name`` (key, tokens) from ``text`` of ``source``."""
    url = f"length(r) <= 500 AND (regexp_matches(r, '^(https?|file)://') OR {url_sql('r')})"
    return {
        f"{name}_a": f"SELECT {key}, t, regexp_extract_all(t, '{CODE}') AS codes, string_split_regex(t, '{CODE}') AS pieces FROM (SELECT {key}, coalesce({text}, '') AS t FROM {source})",
        f"{name}_b": f"""SELECT {key}, codes, list_filter(string_split_regex(array_to_string(list_transform(pieces,
            lambda p, i: CASE WHEN i = 1 THEN p ELSE '__code_block_' || (i - 2) || '__' || p END), ''), '{SPACE}+'), lambda r: r <> '') AS runs FROM {name}_a""",
        f"{name}_c": f"""SELECT {key}, codes, runs, array_to_string(list_transform(runs,
            lambda r, i: CASE WHEN {url} THEN '__url_' || (i - 1) || '__' ELSE r END), ' ') AS p FROM {name}_b""",
        f"{name}_d": f"""SELECT {key}, codes, runs, regexp_matches(p, '{CJK}') AS cjk,
            lower(CASE WHEN regexp_matches(p, '{CJK}') THEN nfc_normalize(p) ELSE p END) AS l FROM {name}_c""",
        f"{name}_s": f"SELECT *, regexp_extract_all(l, '{CJK}') AS signs FROM {name}_d",
        f"{name}_e": f"""SELECT {key}, codes, runs, CASE WHEN cjk THEN list_concat(
                list_filter(regexp_extract_all(l, '{CJK}|[a-z0-9_\\-]+'), lambda w: regexp_matches(w, '{CJK}') OR length(w) > 2 AND NOT list_contains({STOPS}, w)),
                list_transform(range(1, greatest(len(signs), 1)), lambda i: signs[i] || signs[i + 1]))
            ELSE list_transform(list_filter(string_split_regex(regexp_replace(l, '[^\\w\\s\\-_]', ' ', 'g'), '\\s+'),
                lambda w: length(w) > 2 AND NOT list_contains({STOPS}, w)), lambda w: {stem_sql('w')}) END AS toks FROM {name}_s""",
        name: f"""SELECT {key}, string_split_regex(array_to_string(list_transform(toks, lambda w: CASE
                WHEN starts_with(w, '__code_block_') THEN coalesce(trim(replace(codes[try_cast(regexp_extract(w, '^__code_block_(\\d+)', 1) AS INT) + 1], '`', ''), '{BLANKS}'), w)
                WHEN starts_with(w, '__url_') THEN coalesce(runs[try_cast(regexp_extract(w, '^__url_(\\d+)', 1) AS INT) + 1], w)
                ELSE w END), ' '), '{SPACE}+') AS tokens FROM {name}_e""",
    }


_H = hash_sql("term")


def filter_parts(prefix: str, terms: str, m: str) -> dict[str, str]:
    """(doc_id, bit) and (doc_id, n) from (doc_id, term) rows."""
    return {
        f"{prefix}hashed": f"SELECT term, {_H[0]} AS h0, {_H[1]} AS h1, {_H[2]} AS h2 FROM (SELECT DISTINCT term FROM {terms})",
        f"{prefix}bits": f"SELECT DISTINCT doc_id, unnest([h0 % m, h1 % m, h2 % m]) AS bit FROM (SELECT doc_id, h0, h1, h2, {m} AS m FROM {terms} JOIN {prefix}hashed USING (term), conf)",
        f"{prefix}pops": f"SELECT doc_id, count(*) AS n FROM {prefix}bits GROUP BY doc_id",
    }


def _ranked_sql(documents: str, where: str) -> str:
    return f"""SELECT word, df, coverage, rank FROM (
        SELECT word, df, df / {documents} AS coverage, row_number() OVER (ORDER BY df DESC, first_doc, first_pos) AS rank FROM (
            SELECT word, count(*) AS df, min(doc_id) AS first_doc, arg_min(pos, doc_id) AS first_pos FROM (
                SELECT word, doc_id, min(pos) AS pos FROM (
                    SELECT doc_id, lower(unnest(tokens)) AS word, unnest(range(len(tokens))) AS pos FROM {where}
                ) WHERE length(word) > 2 GROUP BY word, doc_id
            ) GROUP BY word HAVING count(*) >= 5
        )) WHERE coverage >= 0.5 OR rank <= 200"""


def _kept_sql(prefix: str, tokens: str) -> str:
    return f"""SELECT doc_id, list_filter(list_transform(tokens, lambda w: lower(w)),
            lambda w: (length(w) > 2 OR regexp_matches(w, '{CJK}')) AND NOT (coalesce(doc_id >= since, false) AND list_contains(common, w))) AS kept
        FROM {tokens}, {prefix}since"""


def stopword_parts(prefix: str, tokens: str) -> dict[str, str]:
    """Stopwords of all documents."""
    return {
        f"{prefix}stop": _ranked_sql("(SELECT count(*) FROM docs)", tokens),
        f"{prefix}since": f"SELECT min(doc_id) AS since, coalesce((SELECT list(word) FROM {prefix}stop), []) AS common FROM docs",
        f"{prefix}kept": _kept_sql(prefix, tokens),
    }


def first_stopword_parts(prefix: str, tokens: str, count: int) -> dict[str, str]:
    """Stopwords of the first ``count`` documents, the last of which is the first that is filtered."""
    return {
        f"{prefix}firsts": f"SELECT doc_id FROM docs ORDER BY doc_id LIMIT {count}",
        f"{prefix}stop": _ranked_sql(str(count), f"{tokens} WHERE doc_id IN (SELECT doc_id FROM {prefix}firsts)"),
        f"{prefix}since": f"""SELECT max(doc_id) AS since, coalesce((SELECT list(word) FROM {prefix}stop), []) AS common FROM {prefix}firsts
            HAVING count(*) = {count} UNION ALL SELECT NULL, [] WHERE (SELECT count(*) FROM {prefix}firsts) < {count}""",
    }


_PAIRS = "list_transform(range(1, least({cap}, len({w}) - 1) + 1), lambda i: {w}[i] || ' ' || {w}[i + 1])"

#: Named parts of the SQL. A part may use those before it.
PARTS: dict[str, str] = {
    "docs": r"""SELECT doc_id, path, title, title || ' ' || coalesce(text, '') AS text, mtime FROM (
        SELECT *, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') AS title FROM documents)""",
    "conf": "SELECT count(*) AS n, 8192 AS m FROM docs",
    **token_parts("toks", "docs", "doc_id", "text"),
    **stopword_parts("", "toks"),
    "filtered": "SELECT doc_id, array_to_string(kept, ' ') AS text FROM kept",
    **token_parts("words", "filtered", "doc_id", "text"),
    "term_rows": f"SELECT DISTINCT doc_id, unnest(list_concat(tokens, {_PAIRS.format(w='tokens', cap='len(tokens)')})) AS term FROM words",
    **filter_parts("", "term_rows", "m"),
    **token_parts("old_toks", "docs", "doc_id", "text"),
    **stopword_parts("old_", "old_toks"),
    "old_rows": f"SELECT DISTINCT doc_id, unnest(list_concat(kept, {_PAIRS.format(w='kept', cap='300')})) AS term FROM (SELECT doc_id, list_filter(kept, lambda w: w <> '') AS kept FROM old_kept)",
    **filter_parts("old_", "old_rows", "256"),
    "posted": """SELECT doc_id, min(pos) AS pos, word FROM (
        SELECT doc_id, lower(unnest(tokens)) AS word, unnest(range(len(tokens))) AS pos FROM toks)
        WHERE length(word) BETWEEN 3 AND 20 AND len(regexp_extract_all(word, '[^a-z0-9]')) <= 0.3 * length(word)
            AND NOT (regexp_matches(word, '^\\d+$') AND length(word) < 4)
        GROUP BY doc_id, word""",
    "admitted": "SELECT word FROM posted, conf GROUP BY word, n HAVING n < 10 OR count(*) / n <= 0.7 AND count(*) >= CASE WHEN n > 100 THEN 2 ELSE 1 END",
    "windex": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, pos, word FROM posted
        WHERE word IN (SELECT word FROM admitted) OR doc_id NOT IN (SELECT doc_id FROM posted WHERE word IN (SELECT word FROM admitted))""",
    "overlap": f"""SELECT b.doc_id, count(*) AS c FROM bits a JOIN bits b ON a.bit = b.bit AND b.doc_id <> a.doc_id WHERE a.doc_id = {QUERY} GROUP BY b.doc_id""",
    "scores": f"""SELECT p.doc_id, {score_sql('q.n', 'p.n', 'coalesce(o.c, 0)', 'm', '3')} AS similarity
        FROM pops p JOIN pops q ON q.doc_id = {QUERY} AND p.doc_id <> {QUERY} LEFT JOIN overlap o ON o.doc_id = p.doc_id, conf""",
}


#: The parts that differ where the limits of the original provider hold: texts cut and filters halved by corpus size,
#: the first word pairs only, stopwords of the first documents.
COMPAT_PARTS = {
    "conf": "SELECT count(*) AS n, CASE WHEN count(*) > 5000 THEN 4096 ELSE 8192 END AS m, CASE WHEN count(*) > 5000 THEN 5000 ELSE 10000 END AS lim FROM docs",
    "texts": f"SELECT doc_id, left(text, {kept_sql('text', 'lim')}) AS text FROM docs, conf WHERE length(text) <= 10485760",
    **token_parts("toks", "texts", "doc_id", "text"),
    **first_stopword_parts("", "toks", 30),
    "term_rows": f"""SELECT DISTINCT doc_id, unnest(list_concat(w, {_PAIRS.format(w='w', cap='cap')})) AS term FROM (
        SELECT doc_id, tokens AS w, CASE WHEN len(list_distinct(tokens)) <= 500 THEN CASE WHEN cjk THEN 100 ELSE 200 END
            ELSE CASE WHEN cjk THEN 50 ELSE 100 END END AS cap
        FROM words JOIN (SELECT doc_id, regexp_matches(text, '{CJK}') AS cjk FROM filtered) USING (doc_id))""",
}
LEGACY_COMPAT_PARTS = {
    "old_texts": "SELECT doc_id, text FROM docs WHERE length(text) <= 10485760",
    **token_parts("old_toks", "old_texts", "doc_id", "text"),
    **first_stopword_parts("old_", "old_toks", 100),
}


def sql(select: str, **more: str) -> str:
    """A statement of ``select`` with the parts that it needs in front, each behind those that it uses."""
    parts = PARTS | more
    order: dict[str, None] = {}
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in parts:
            if name not in seen and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                seen.add(name)
                need(parts[name])
                order[name] = None

    need(select)
    chain = ",\n".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in order)
    return f"WITH {chain}\n{select}" if chain else select
