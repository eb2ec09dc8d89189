"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_lexicon_bpe import op1_lexicon_bpe
from . import op02_snapshots
from .op02_snapshots import op2_snapshots
from .op03_chaining import op3_chaining
from .op04_runindex import op4_runindex
from .op05_minhash import op5_minhash
from . import op06_line_chunks
from .op06_line_chunks import op6_line_chunks
from .op07_kernel_langid import op7_kernel_langid
from .op08_spaced_seeds import op8_spaced_seeds
from . import op09_cascade
from . import op10_licenses as _op10
from .op10_licenses import op10_licenses
from .op09_cascade import op9_cascade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lexicon_bpe": op1_lexicon_bpe,
    "op2_snapshots": op2_snapshots,
    "op3_chaining": op3_chaining,
    "op4_runindex": op4_runindex,
    "op5_minhash": op5_minhash,
    "op6_line_chunks": op6_line_chunks,
    "op7_kernel_langid": op7_kernel_langid,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_cascade": op9_cascade,
    "op10_licenses": op10_licenses,
}

ORACLES: dict[str, str] = {
    "op10_licenses": _op10.SQL,
    "op2_snapshots": op02_snapshots.SQL,
    "op6_line_chunks": op06_line_chunks.SQL,
    "op9_cascade": op09_cascade.SQL,
}
