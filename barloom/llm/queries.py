"""The queries of the training-data operators and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_tree import op10_bpe_tree
from .class_lm import op5_class_lm
from .decontaminate import OP8_SQL, op8_decontaminate
from .edit_counts import op2_edit_counts
from .gif_media import op3_gif_media
from .licences import OP7_SQL, op7_licences
from .line_dedup import op4_line_dedup
from .merkle import OP11_SQL, op11_merkle
from .near_dedup import op1_near_dedup
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .subwords import op12_quality
from .templates import op9_main_text
from .toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_edit_counts, op3_gif_media, op4_line_dedup, op5_class_lm, op6_toxicity, op7_licences, op8_decontaminate, op9_main_text, op10_bpe_tree, op11_merkle, op12_quality, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op7_licences": OP7_SQL, "op8_decontaminate": OP8_SQL, "op11_merkle": OP11_SQL, "op13_prefix_trie": OP13_SQL}
