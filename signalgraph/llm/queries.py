"""The operators of this folder as named queries over the driver's tables."""

from __future__ import annotations

from signalgraph.llm import common as C
from signalgraph.llm import (
    graph_index,
    line_dedup,
    nbest,
    packing,
    periodic_runs,
    quality_rules,
    sharding,
    simhash,
    site_quality,
    suffix_dedup,
    token_files,
    url_filter,
    whitening,
)
from signalgraph.sources.staging import staged_at


def op1_label_propagation(spark, folder):
    return sharding.digest(C.table(spark, folder, "documents"))


def op2_covering_simhash(spark, folder):
    return simhash.digest(C.table(spark, folder, "documents"))


def op3_best_fit_packing(spark, folder):
    return packing.pack_documents(C.table(spark, folder, "documents"))


def op4_graph_search(spark, folder):
    return graph_index.nearest(C.table(spark, folder, "embeddings"))


def op5_nbest_pieces(spark, folder):
    return nbest.digest(C.table(spark, folder, "documents"))


def op6_site_quality(spark, folder):
    return site_quality.judged(C.table(spark, folder, "documents"), C.table(spark, folder, "labels"))


def op7_line_dedup(spark, folder):
    return line_dedup.digest(C.table(spark, folder, "documents"))


def op8_quality_rules(spark, folder):
    return quality_rules.digest(C.table(spark, folder, "documents"))


def op9_suffix_dedup(spark, folder):
    return suffix_dedup.digest(C.table(spark, folder, "documents"))


def op10_token_files(spark, folder):
    path = staged_at(spark, "token-files")
    token_files.save(C.table(spark, folder, "documents"), path)
    return token_files.read_documents(*token_files.load(spark, path))


def op11_periodic_runs(spark, folder):
    return periodic_runs.digest(C.table(spark, folder, "documents"))


def op12_whitening(spark, folder):
    return whitening.whitened(C.table(spark, folder, "embeddings"))


def op13_url_filter(spark, folder):
    found = url_filter.judged(C.table(spark, folder, "pages"), C.table(spark, folder, "documents"))
    return found.select("page_id", "host", "path", "rule", "verdict", "odds")


QUERIES = {
    f.__name__: f
    for f in (
        op1_label_propagation,
        op2_covering_simhash,
        op3_best_fit_packing,
        op4_graph_search,
        op5_nbest_pieces,
        op6_site_quality,
        op7_line_dedup,
        op8_quality_rules,
        op9_suffix_dedup,
        op10_token_files,
        op11_periodic_runs,
        op12_whitening,
        op13_url_filter,
    )
}

_WHITE = "concat(" + ", ".join(f"chr({k})" for k in (9, 10, 11, 12, 13, 32)) + ")"

#: The others need a tokenizer, XXH64, iteration or an estimate; tests/llm holds them against plain loops.
ORACLES: dict[str, str] = {
    "op7_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, pos, line,
    translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split)),
held AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT lines.*, coalesce(doc_id <> keeper, false) AS gone FROM lines LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
}
