"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import exactdedup, linechunks, merkle, minhash, topk
from factgraph.llm.annsearch import op8_ann
from factgraph.llm.bpe import op1_bpe
from factgraph.llm.exactdedup import op11_exact_dedup
from factgraph.llm.langid import op3_langid
from factgraph.llm.linechunks import op7_line_dedup
from factgraph.llm.merkle import op13_merkle
from factgraph.llm.minhash import op9_minhash
from factgraph.llm.packing import op6_packing
from factgraph.llm.pagetext import op5_html
from factgraph.llm.periodic import op12_periodic
from factgraph.llm.pii import op4_pii
from factgraph.llm.secretscan import op2_secrets
from factgraph.llm.topk import op10_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_secrets": op2_secrets,
    "op3_langid": op3_langid,
    "op4_pii": op4_pii,
    "op5_html": op5_html,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_ann": op8_ann,
    "op9_minhash": op9_minhash,
    "op10_topk": op10_topk,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_periodic": op12_periodic,
    "op13_merkle": op13_merkle,
}

#: The others can't be said in SQL as a whole; tests/llm holds each against a brute-force version.
ORACLES: dict[str, str] = {"op7_line_dedup": linechunks.ORACLE_SQL, "op9_minhash": minhash.ORACLE_SQL, "op10_topk": topk.ORACLE_SQL, "op11_exact_dedup": exactdedup.ORACLE_SQL, "op13_merkle": merkle.ORACLE_SQL}
