"""The queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classlm, decontam, html, langid, minhash, packing, quality, repair, sharding, toxicity, trie, urls
from .common import cut, fold, read


def _held_out(key: str, remainder: int):
    return F.coalesce(fold(key) == remainder, F.lit(False))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by balanced propagation, law rows; NULL texts have size 16."""
    return sharding.shard(read(spark, sf_dir, "documents")).drop("hub")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share four fifths of their shingles of four words."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 ids at most; ids as their crc32. NULL texts are one end id."""
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document, learnt from the labels outside of the fold that is held out."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; NULL pages have none."""
    pages = read(spark, sf_dir, "pages")
    # The url rides along as part of the key, so that no join is needed.
    boxed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    return html.extract(boxed, key="page").select("page_id.page_id", "page_id.url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's address."""
    return urls.filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the class model, and under single words."""
    return classlm.score(read(spark, sf_dir, "documents"), fold("doc_id") == 1)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all items of the benchmark, the best place of each pair."""
    found = decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("item_tokens").cast("long").alias("item_tokens"), F.col("matched").cast("long").alias("matched"), F.col("position").cast("long").alias("position"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows outside of the fold that is held out."""
    docs = read(spark, sf_dir, "documents")
    found = langid.detect(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select(F.col("row.doc_id").alias("doc_id"), _held_out("row.doc_id", 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; NULL texts are empty and fail."""
    return quality.quality(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Fixed value: both turns of conversation -7, with the strings that mark turns.
CONTROLS = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of one whose texts hold control strings, read back from the
    formatted texts. NULL texts are empty; ties of turn go by role and text."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROLS).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(rows))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: some turns lost, emptied, without stops, said twice or given to the user, as
    crc32 of conversation and turn decides; lost ones stay as rows that are not there. NULLs are one blank."""
    blank = F.lit(" ")
    lot = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    some = rows.select("conv_id", "turn", F.when(lot == 4, "user").otherwise(role).alias("role"), F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (lot != 0).alias("there"), lot.alias("lot"))
    return some.select("conv_id", "turn", "role", "text", "there", F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of all conversations after damage."""
    fixed = repair.repair(damaged(read(spark, sf_dir, "conversations")), present="there")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(joined.cast("binary"), 256).alias("repaired_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the start of the one that its id names. Rows without a
    conv_id belong to no conversation and are left out."""
    turns = cut(trie.turn_rows(read(spark, sf_dir, "conversations")))
    c = F.col("conv_id")
    return trie.prefix_trie(*trie.grafted(turns, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, longest=3))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_near_duplicates, op3_packing, op4_toxicity, op5_html, op6_urls, op7_class_lm, op8_decontamination, op9_language, op10_quality, op11_chat_format, op12_repair, op13_prefix_trie)
}


def _stop_list() -> str:
    return ", ".join("'" + w + "'" for w in quality.STOP_WORDS)


def _rule_sql() -> str:
    out = []
    for r in quality.RULES:
        ratio = f"(CASE WHEN {r.denominator} > 0 THEN {r.numerator}::DOUBLE / {r.denominator} ELSE 0 END)"
        out += [f"{ratio} >= {r.low}"] if r.low is not None else []
        out += [f"{ratio} <= {r.high}"] if r.high is not None else []
    return " AND ".join(out)


_LINE = r"[^\x20\x09-\x0D]"
_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_LINE}+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_LINE}')) AS l FROM d),
tri AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l) AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({_stop_list()}))) AS n_stop_words,
        len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-•*]'))) AS n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND {_rule_sql()} AS kept
FROM m"""

_OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LINE}+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN near e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
#: Without seeds: every alignment with enough equal tokens is looked at.
_OP8 = f"""
WITH i AS (SELECT *, row_number() OVER () AS iid, len(iw) AS n FROM (SELECT DISTINCT item_id, {_WORDS} AS iw FROM benchmark) WHERE len(iw) >= {decontam.MIN_TOKENS}),
d AS (SELECT *, row_number() OVER () AS did FROM (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)),
it AS (SELECT iid, n, unnest(iw) AS t, unnest(range(1, n + 1)) AS p FROM i),
dt AS (SELECT did, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
al AS (SELECT did, iid, dt.p - it.p AS position FROM dt JOIN it ON dt.t = it.t GROUP BY did, iid, dt.p - it.p, n HAVING 100 * count(*) >= {decontam.AGREE_PERCENT} * least(n, {decontam.OVERLAP})),
e AS (SELECT doc_id, item_id, n, position, list_transform(range(greatest(1, 1 - position), least(n, len(w) - position) + 1), lambda j: CASE WHEN w[position + j] = iw[j] THEN 1 ELSE 0 END) AS same FROM al JOIN d ON d.did = al.did JOIN i ON i.iid = al.iid),
v AS (SELECT *, list_sum(same) AS matched, least(n, {decontam.OVERLAP}) AS span FROM e WHERE len(same) >= least(n, {decontam.OVERLAP})),
b AS (SELECT *, list_max(list_transform(range(1, len(same) - span + 2), lambda j: list_sum(same[j : j + span - 1]))) AS best FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, position) AS k FROM b WHERE 100 * best >= {decontam.AGREE_PERCENT} * span)
SELECT doc_id, item_id, n::BIGINT AS item_tokens, matched::BIGINT AS matched, position::BIGINT AS position FROM r WHERE k = 1"""


def _judge_sql(host: str, path: str, value: str) -> str:
    order = sorted(urls.RULES, key=lambda r: (-len(r.name), r.block, r.name))
    pick = {"name": lambda r: f"'{r.name}'", "block": lambda r: str(r.block).upper()}[value]
    return "CASE " + " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN {pick(r)}" for r in order) + " END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same reading of markup, for an engine without look-ahead: what ends a name is read with it.
_NO_MARKUP = "(?is)<!--.*?(-->|$)|" + "|".join(rf"<{n}([\s/][^<>]*)?>.*?(</{n}[\s/>]|$)" for n in ("script", "style", "template", "noscript"))
_ELEMENT = r"""(?is)<(?:link|meta|base)[\s/](?:=\s*"[^"]*"|=\s*'[^']*'|[^<>"'=]|[="'])*>"""
_ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_BLANKS = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"


def _decoded_sql(text: str) -> str:
    """Numeric references and the five names of markup, each decoded once."""
    name = "split_part(x, ';', 1)"
    rest = "substr(x, instr(x, ';') + 1)"
    code = f"CASE WHEN regexp_matches(x, '^#[0-9]{{1,7}};') THEN substr({name}, 2)::BIGINT WHEN regexp_matches(x, '^#[xX][0-9A-Fa-f]{{1,6}};') THEN ('0x' || substr({name}, 3))::BIGINT ELSE list_extract([38, 60, 62, 34, 39], list_position(['amp', 'lt', 'gt', 'quot', 'apos'], CASE WHEN contains(x, ';') THEN {name} END)) END"
    return f"split_part({text}, '&', 1) || coalesce(array_to_string(list_transform(string_split({text}, '&')[2:], lambda x: coalesce(chr(({code})::INTEGER) || {rest}, '&' || x)), ''), '')"


_UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_NODE = f"CASE WHEN regexp_matches({{0}}, '^[^:/?#]*://[^/?#]') THEN translate(regexp_extract({{0}}, '^[^:/?#]*://([^/?#]*)', 1), {_UP}) || regexp_extract({{0}}, '^[^:/?#]*://[^/?#]*([^#]*)', 1) END"
_OP6 = f"""
WITH RECURSIVE r AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UP}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
h AS (SELECT row_number() OVER () AS row, url, unnest(regexp_extract_all(regexp_replace(html, {_quoted(_NO_MARKUP)}, ' ', 'g'), {_quoted(_ELEMENT)})) AS tag FROM p),
a AS (SELECT row, url, place, tag, unnest(regexp_extract_all(tag, {_quoted(_ATTRIBUTE)})) AS att, unnest(range(len(regexp_extract_all(tag, {_quoted(_ATTRIBUTE)})))) AS nr FROM (SELECT *, row_number() OVER () AS place FROM h)),
m AS (SELECT place, any_value(row) AS row, any_value(url) AS u, lower(any_value(att) FILTER (nr = 0)) AS tag, {", ".join(f"""trim(arg_min(CASE WHEN regexp_matches(att, '(?s)=[[:space:]]*["'']') THEN substr(ltrim(substr(att, instr(att, '=') + 1), {_BLANKS}), 2, length(ltrim(substr(att, instr(att, '=') + 1), {_BLANKS})) - 2)
        WHEN contains(att, '=') THEN ltrim(substr(att, instr(att, '=') + 1), {_BLANKS}) ELSE '' END, nr) FILTER (lower(rtrim(split_part(att, '=', 1), {_BLANKS})) = '{n}' AND nr > 0), {_BLANKS}) AS "{n}" """ for n in ("href", "rel", "content", "http-equiv"))} FROM a GROUP BY place),
n AS (SELECT row, any_value(u) AS u, arg_min(href, place) FILTER (tag = 'base' AND href IS NOT NULL) AS base,
        arg_min(href, place) FILTER (tag = 'link' AND list_contains(regexp_split_to_array(lower(rel), '[[:space:]]+'), 'canonical') AND href IS NOT NULL) AS canonical,
        arg_min(content, place) FILTER (tag = 'meta' AND lower("http-equiv") = 'refresh' AND content IS NOT NULL) AS refresh FROM m GROUP BY row),
t AS (SELECT u, {_decoded_sql("coalesce(base, '')")} AS base, {_decoded_sql("v")} AS v FROM (SELECT u, base, unnest([canonical, regexp_extract(refresh, '(?is)(^|[[:space:];,])url[[:space:]]*=[[:space:]]*["'']?([^"''[:space:]>]+)', 2)]) AS v FROM n)),
v AS (SELECT CASE WHEN regexp_matches(base, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN base WHEN starts_with(base, '/') AND NOT starts_with(base, '//') THEN regexp_extract(u, '^([^:/?#]*://[^/?#]*)', 1) || base ELSE u END AS f, u, v FROM t),
x AS (SELECT u, CASE WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN v WHEN starts_with(v, '//') THEN 'http:' || v
        WHEN starts_with(v, '/') THEN regexp_extract(f, '^([^:/?#]*://[^/?#]*)', 1) || v ELSE regexp_extract(f, '^([^?#]*/)', 1) || v END AS v FROM v WHERE v <> ''),
e AS (SELECT {_NODE.format("u")} AS a, {_NODE.format("v")} AS b FROM x),
near AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a, a AS b FROM near UNION SELECT q.a, n.b FROM reach q JOIN near n ON q.b = n.a),
said AS (SELECT a, {_judge_sql("regexp_extract(b, '^([^/?]*)', 1)", "regexp_extract(b, '^[^/?]*([^?]*)', 1)", "block")} AS block FROM reach),
alias AS (SELECT a, bool_or(NOT block) AS allowed, bool_or(block) AS blocked FROM said GROUP BY a)
SELECT page_id, host, path, {_judge_sql("host", "path", "name")} AS rule,
       CASE WHEN coalesce({_judge_sql("host", "path", "block")}, CASE WHEN allowed THEN FALSE WHEN blocked THEN TRUE END, FALSE) THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN alias ON alias.a = {_NODE.format("url")}"""

def _controls_sql(text: str) -> str:
    """How many backslashes the template puts into a text."""
    return rf"(len(regexp_extract_all({text}, '\\')) + coalesce(list_sum(list_transform(regexp_extract_all({text}, '###+'), lambda x: length(x) - 2)), 0) + len(regexp_extract_all({text}, '</turn>')))"


_OP11 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', {_quoted(CONTROLS)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(CONTROLS)}),
n AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
        ELSE 1 + length(role) + {_controls_sql("role")} + length(role) - length(replace(role, ':', '')) END AS label FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len("###  : </turn>") - 1} + label + length(text) + {_controls_sql("text")} + 1)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""


def _crc_sql(text: str) -> str:
    """crc32 of a text of ASCII letters, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(0, 8), lambda k: (ascii(c)::BIGINT >> k) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"


def _edit_sql(weight: str, cost: str, letter: str, line: str) -> str:
    """A repair as text: cost in 12 digits, audit, a sign before all letters, lines. Puts an edit before it."""
    mark = f"instr({weight}, chr(1))"
    line = f"{line} || chr(10)" if line else "''"
    return f"lpad((substr({weight}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{letter}' || substr({weight}, 13, {mark} - 12) || {line} || substr({weight}, {mark} + 1)"


_STATES = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def _row_sql(state: int) -> str:
    to, role = _STATES[state]
    kept = {0: f"WHEN i1 = 's' THEN w1 WHEN i1 = 'u' THEN w{to}", 2: f"WHEN i1 = 'a' THEN w{to}"}.get(state, f"WHEN i1 = 'u' THEN w{to}")
    return f"least({_edit_sql(f'w{state}', '4', 'D', '')}, CASE WHEN fault NOT IN ('b', 'd') THEN {_edit_sql(f'(CASE {kept} END)', 'late', 'K', 'line')} END, CASE WHEN fault NOT IN ('b', 'd') THEN {_edit_sql(f'w{to}', '3 + late', 'R', _quoted(role + ':') + ' || text')} END) AS g{state}"


def _gap_sql(state: int) -> str:
    to, role = _STATES[state]
    then, next_role = _STATES[to]
    once = _edit_sql(f"g{to}", "3", "I", _quoted(role + ":"))
    return f"least(g{state}, {once}, {_edit_sql('(' + _edit_sql(f'g{then}', '3', 'I', _quoted(next_role + ':')) + ')', '3', 'I', _quoted(role + ':'))}) AS w{state}"


_OP12 = f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot FROM conversations),
d AS (SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE lot WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM o WHERE lot <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, role || ':' || text AS line, substr(role, 1, 1) AS i1, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS i0,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
             WHEN regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
k AS (SELECT *, CASE fault WHEN 't' THEN 3 ELSE 0 END AS late FROM f),
c AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND i0 || i1 NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id),
g AS (SELECT conv_id, n AS i, NULL::VARCHAR AS g1, NULL::VARCHAR AS g2, lpad('0', 12, '0') || chr(1) AS g0, lpad('0', 12, '0') || chr(1) AS g3 FROM c),
s AS (SELECT conv_id, i, {", ".join(f"CASE WHEN g{q} IS NULL AND g{_STATES[q][0]} IS NULL THEN {_edit_sql('(' + _edit_sql('g3', '3', 'I', _quoted('assistant:')) + ')', '3', 'I', _quoted('user:'))} ELSE {_gap_sql(q).rpartition(' AS ')[0]} END AS w{q}" for q in range(4))} FROM g
      UNION ALL
      SELECT conv_id, i, {", ".join(_gap_sql(q) for q in range(4))} FROM
        (SELECT s.conv_id, s.i - 1 AS i, {", ".join(_row_sql(q) for q in range(4))} FROM s JOIN k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.i = s.i)),
best AS (SELECT conv_id, w0, instr(w0, chr(1)) AS mark FROM s WHERE i = 0)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(substr(w0, 1, 12)::BIGINT, 0) AS cost, coalesce(substr(w0, 13, mark - 13), '') AS audit,
       sha256(coalesce(substr(w0, mark + 1, greatest(length(w0) - mark - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id"""

_OP13 = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 20 AS base, {_crc_sql("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS half, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h UNION ALL SELECT h.c, 1, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
p AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY half, pos) AS d, to_json(list(struct_pack(role, text)) OVER (PARTITION BY c ORDER BY half, pos)) AS k FROM r),
q AS (SELECT c, d, k, len(regexp_extract_all(text, '{_LINE}+')) AS words FROM p UNION ALL SELECT c, 0, '[]', 0 FROM h),
e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM q),
n AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY d, k),
u AS (SELECT n.*, m.c AS up FROM n LEFT JOIN q ON q.c = n.c AND q.d = n.d - 1 LEFT JOIN n m ON m.d = q.d AND m.k = q.k),
kids AS (SELECT up AS c, d - 1 AS d, count(*) AS n FROM u WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT u.*, coalesce(kids.n, 0) AS n_children, (u.n_convs - 1) * u.words AS saved FROM u LEFT JOIN kids ON kids.c = u.c AND kids.d = u.d),
sums AS (SELECT q.d, q.k, count(*) FILTER (own.n_children = 0) AS n_leaves, sum(own.saved) AS saved_tokens FROM own JOIN q ON q.c = own.c AND q.d <= own.d GROUP BY q.d, q.k)
SELECT own.c AS conv_id, own.d::BIGINT AS depth, own.up AS parent_conv_id, own.n_convs, own.n_children, sums.n_leaves, sums.saved_tokens::BIGINT AS saved_tokens, own.ends_sha256 FROM own JOIN sums ON sums.d = own.d AND sums.k = own.k"""

ORACLES: dict[str, str] = {"op2_near_duplicates": _OP2, "op6_urls": _OP6, "op8_decontamination": _OP8, "op10_quality": _OP10, "op11_chat_format": _OP11, "op12_repair": _OP12, "op13_prefix_trie": _OP13}
