"""Registered queries of the llm subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import bpe, history_graph, leaks, same_record, shared_spans
from keystrata.llm.seen_keys import SeenKeys
from keystrata.plans.session import shared_dir

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCHED = {"stored_results": "result_id", "access_entries": "seq"}


def _both(spark: SparkSession, d: str, cases: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`cases` of both tables, worked on side by side."""
    with ThreadPoolExecutor(len(BATCHED)) as pool:
        parts = list(pool.map(lambda t: cases(table(spark, d, t), BATCHED[t]).select(F.lit(t).alias("table_name"), "first_id", "dup_id"), BATCHED))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, lambda rows, i: history_graph.link(rows, i, batch="batch_no"))


#: Batches of one delivery in p2_batches.
DELIVERY = 20


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same rows, the batches arriving in deliveries of DELIVERY batches; each delivery opens the saved index anew."""

    def cases(rows: DataFrame, i: str) -> DataFrame:
        path, parts = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", []
        last = rows.agg(F.max("batch_no")).first()[0] or 0
        for k in range(0, last + 1, DELIVERY):
            batch = F.coalesce("batch_no", F.lit(0))
            parts.append(history_graph.HistoryIndex(spark, path).add(rows.where((batch >= k) & (batch < k + DELIVERY)), i, batch="batch_no"))
        history_graph.HistoryIndex(spark, path).drop()
        return reduce(DataFrame.unionByName, parts)

    return _both(spark, d, cases)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return SeenKeys().seen(table(spark, d, "wanted_keys"), table(spark, d, "key_index"))


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return SeenKeys().rate(table(spark, d, "wanted_keys"), table(spark, d, "key_index"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return same_record.copies(table(spark, d, "posted_records"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return same_record.collapsed(table(spark, d, "posted_records"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    kept = leaks.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return kept.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("parent_id", "n_chars")})  # so that both engines give these columns one integer type


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_documents(table(spark, d, "documents"))


def p8_amounts(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_amounts(table(spark, d, "documents"))


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.sentence_cover(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_batches, p3_found, p3_error_rate, p4_found, p4_records, p6_ids, p7_found, p7_matches, p7_clean, p8_found, p8_amounts, p8_sentences)
}
_WS = r"[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trimmed(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


def _letters(c: str) -> str:
    return f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


_PIECES = f"list_filter(regexp_split_to_array(body, '[;|\n]'), lambda p: {_trimmed('p')} <> '')"
_NAME, _VALUE = _letters("regexp_extract(p, '(?s)^([^=:]*)', 1)"), "regexp_extract(p, '(?s)^[^=:]*[=:](.*)$', 1)"
_QUOTED = _WS[:-1] + "\"''`\\x{201c}\\x{201d}\\x{2018}\\x{2019}\\x{ab}\\x{bb}]"
_REST = f"regexp_replace({_VALUE}, '{_QUOTED}+', '', 'g')"
_FIELD = f"(CASE WHEN {_NAME} = 'smiles' THEN 'input' ELSE {_NAME} END) || chr(1) || (CASE WHEN {_NAME} IN ('input', 'smiles') OR regexp_full_match({_REST}, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN lower({_REST}) ELSE {_letters(_VALUE)} END)"
_RECORDS = f"(SELECT rec_id, list_sort(list_transform({_PIECES}, lambda p: {_FIELD})) AS record FROM posted_records WHERE {_trimmed('body')} <> '')"
_MARKUP = r"</?[A-Za-z][^<>\n]*>|\[/?[A-Za-z*][^\[\]\n]*\]|&#?[0-9A-Za-z]{1,10};"


def _runs(table_name: str, id: str, text: str) -> str:
    """Every eight consecutive words of a text."""
    words = f"list_transform(regexp_extract_all(regexp_replace({text}, '{_MARKUP}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"
    return f"(SELECT DISTINCT {id}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS run FROM (SELECT {id}, {words} AS w FROM {table_name} WHERE {text} IS NOT NULL) WHERE len(w) >= 8)"


_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM {_runs('documents', 'doc_id', 'text')} d JOIN {_runs('eval_items', 'item_id', 'passage')} e ON d.run = e.run"
_INDEXED = f"(SELECT {_trimmed('input')} FROM key_index WHERE {_trimmed('input')} <> '')"
ORACLES: dict[str, str] = {
    "p3_found": f"SELECT ord FROM (SELECT ord, key, min(ord) OVER (PARTITION BY key) AS first FROM (SELECT ord, {_trimmed('input')} AS key FROM wanted_keys) WHERE key <> '') WHERE ord > first OR key IN {_INDEXED}",
    "p4_found": f"SELECT * FROM (SELECT min(rec_id) OVER (PARTITION BY record) AS first_id, rec_id FROM {_RECORDS}) WHERE first_id < rec_id",
    "p7_found": _LEAKS,
    "p7_clean": f"SELECT * REPLACE (coalesce(parent_id, -1)::BIGINT AS parent_id, coalesce(n_chars, -1)::BIGINT AS n_chars) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_LEAKS}))",
}
