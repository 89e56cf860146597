"""The registered queries: each applies one operator, with its production
parameters, to its whole table and gives the digest columns of its contract.
``SQL`` has the equivalent DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    boosted,
    bpe,
    decontaminate,
    importance,
    langid,
    linededup,
    merkle,
    pii,
    quality,
    simhash,
    suffixdedup,
    tokencount,
    urltree,
)
from ledgerlens.llm.common import visible_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.substring_report(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The byte-level BPE file of the token operators; vocabularies are read where they are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (``source`` stands for their host, ``lang`` for what they declare) and pages (host of the url, language
    declared in the markup, visible text); ``table`` names the table that ``doc_id`` is an id of."""
    docs = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("table"), "doc_id", "text", "lang", F.col("source").alias("host"))
    html, url = F.col("html"), F.col("url")
    own = [visible_text(html).alias("text"), langid.declared_language(html).alias("lang"), langid.url_host(url).alias("host")]
    pages = _table(spark, sf_dir, "pages").select(F.lit("pages").alias("table"), F.col("page_id").alias("doc_id"), *own)
    return langid.identify(docs.unionByName(pages), ["table", "doc_id"], host=F.col("host"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").withColumn("shown", visible_text(F.col("html")))
    found = urltree.judge(pages, ["page_id"], label=urltree.weak_label(F.col("shown")))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_table(spark, sf_dir, "documents"), ["doc_id"])
    failed = quality.base_failed()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "p_good")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return tokencount.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boosted.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle.verified(docs, suspect=merkle.tampered(), forged={"text": merkle.lowered()})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_simhash,
        op3_line_dedup,
        op4_suffix_dedup,
        op5_language_id,
        op6_pii,
        op7_url_filter,
        op8_quality,
        op9_token_counts,
        op10_bpe,
        op11_importance,
        op12_quality_classifier,
        op13_merkle,
    )
}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
with d as (
  select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') as w from documents
), b as (
  select item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') as w from benchmark
), sized as (
  select item_id, w, least(13, len(w)) as n from b where len(w) > 0
), item_windows as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as k
  from (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from sized)
), doc_windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from sized) where len(w) >= n)
), found as (
  select doc_id, i, x.n, item_id from doc_windows x join item_windows y on x.n = y.n and x.k = y.k
), hits as (
  select doc_id, count(distinct word) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as word from (select distinct doc_id, i, n from found)) group by doc_id
), items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

_OP3 = f"""
with lines as (
  select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, {_ASCII_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from lines
), firsts as (
  select key, min(doc_id) as first_doc from keyed where length(key) >= 10 group by key
), judged as (
  select doc_id, pos, line, coalesce(doc_id > first_doc, false) as dropped from keyed left join firsts using (key)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from judged group by doc_id
"""

#: A table of the CRC-32 of single bytes, and the CRC-32 of a text through it.
_CRC_TABLE = """
crc as (
  select list(v order by i) as tab
  from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) t(i))
)"""


def _crc(text: str) -> str:
    """SQL of the CRC-32 of ``text``, beside the table ``crc``."""
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda j: ('0x' || hex(array_slice(encode({text}), j + 1, j + 1)))::bigint)"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


_OP11 = rf"""
with {_CRC_TABLE}, texts as (
  select 'd' as side, doc_id as id, coalesce(text, '') as text from documents union all select 'b', item_id, coalesce(text, '') from benchmark
), words as (
  select side, id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') as w from texts
), features as (
  select side, id, f, count(*) as c
  from (select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words) group by all
), hashed as (
  select f, {_crc("f")} % 10000 as bucket from (select distinct f from features), crc
), placed as (
  select side, id, bucket, c from features join hashed using (f)
), counts as (
  select bucket, coalesce(sum(c) filter (side = 'd'), 0)::double as s, coalesce(sum(c) filter (side = 'b'), 0)::double as t from placed group by bucket
), sums as (
  select sum(s) as all_s, sum(t) as all_t from counts
), gains as (
  select bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000)))) as gain from counts, sums
), weights as (
  select id, sum(c)::bigint as n_features, floor(sum(c * gain) / sum(c))::bigint as weight from placed join gains using (bucket) where side = 'd' group by id
), noise as (
  select id, len(w) as n_words, ('0x' || substr(sha256('7:' || coalesce(id::varchar, '')), 1, 8))::bigint as h from words where side = 'd'
), scored as (
  select id as doc_id, n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))))::bigint as score
  from noise left join weights using (id)
), drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_words >= 20
)
select doc_id, n_features, weight, score, case when place <= floor(25 * n / 100) then place::bigint end as rank
from scored left join drawn using (doc_id)
"""


def _tree(name: str, levels: int) -> str:
    """CTEs ``name``1 and on, the levels of the trees over ``name``0 (g, idx, h), and their runs of 16."""
    out = []
    for j in range(levels):
        out.append(f"""{name}_runs{j} as (
  select g, idx // 16 as run, list(h order by idx) as hs, max(nodes) as nodes from (select *, count(*) over (partition by g) as nodes from {name}{j}) group by all
), {name}{j + 1} as (
  select g, run as idx, case when nodes > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}_runs{j}
)""")
    return ", ".join(out)


def _folds(source: str, name: str, group: str, place: str, levels: int) -> str:
    """CTEs that fold ``cur`` of the rows of ``source`` up the trees ``name`` and join the siblings on the way to ``sib``."""
    out = []
    for j in range(levels):
        at = f"(({place} // {16**j}) % 16)"
        before, after = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:], '')"
        out.append(f"""{name}_fold{j + 1} as (
  select f.* exclude (cur, sib), case when nodes > 1 then sha256({before} || cur || {after}) else cur end as cur, sib || {before} || {after} as sib
  from {source if j == 0 else f"{name}_fold{j}"} f join {name}_runs{j} r on {group} is not distinct from r.g and {place} // {16 ** (j + 1)} = r.run
)""")
    return ", ".join(out)


def _leaf(text: str) -> str:
    def part(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"

    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: The SQL's trees are of six levels: enough for 16 ** 6 rows of a source, and as many sources.
_LEVELS = 6

_OP13 = f"""
with {_CRC_TABLE}, leaves as (
  select doc_id, source, {_leaf("text")} as leaf, case when {_crc("doc_id::varchar")} % 5 = 0 then {_leaf(_ASCII_LOWER.format("text"))} end as forged
  from documents, crc
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from leaves
), s0 as (select source as g, place as idx, leaf as h from placed), {_tree("s", _LEVELS)}, subroots as (
  select g as source, h as subroot, row_number() over (order by g nulls first) - 1 as nth from s{_LEVELS}
), t0 as (select 0 as g, nth as idx, subroot as h from subroots), {_tree("t", _LEVELS)}, started as (
  select p.*, subroot, nth, coalesce(forged, leaf) as cur, '' as sib from placed p join subroots u on p.source is not distinct from u.source
), {_folds("started", "s", "f.source", "f.place", _LEVELS)}, {_folds(f"s_fold{_LEVELS}", "t", "0", "f.nth", _LEVELS)}
select doc_id, leaf, subroot, h as root, sha256(sib) as proof_sha256, cur as folded_root, cur = h as verified from t_fold{_LEVELS}, t{_LEVELS}
"""

SQL: dict[str, str] = {"op1_decontaminate": _OP1, "op3_line_dedup": _OP3, "op11_importance": _OP11, "op13_merkle": _OP13}
