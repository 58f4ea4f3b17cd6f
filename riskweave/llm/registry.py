"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.decontaminate import op9_decontamination
from riskweave.llm.jaccard import op3_jaccard_join
from riskweave.llm.licenses import op1_licenses, op1_sql
from riskweave.llm.lm import op6_lm_score
from riskweave.llm.mtree import op11_sql, op11_topk
from riskweave.llm.neighbours import op10_neighbours
from riskweave.llm.packing import op4_packing
from riskweave.llm.quality import op2_quality
from riskweave.llm.repeats import op5_repeats
from riskweave.llm.resample import op12_resample, op12_sql
from riskweave.llm.secrets import op8_secrets
from riskweave.llm.trie import op13_sql, op13_trie
from riskweave.llm.warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_licenses, op2_quality, op3_jaccard_join, op4_packing, op5_repeats,
        op6_lm_score, op7_warc, op8_secrets, op9_decontamination, op10_neighbours,
        op11_topk, op12_resample, op13_trie,
    )
}
SQL: dict[str, str] = {
    "op1_licenses": op1_sql(), "op11_topk": op11_sql(), "op12_resample": op12_sql(), "op13_trie": op13_sql(),
}
