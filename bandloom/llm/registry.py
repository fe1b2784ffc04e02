"""The queries of this subpackage, one for each operator, and their SQL."""

from functools import wraps

from bandloom.llm.byte_bpe import op7_byte_bpe
from bandloom.llm.decontaminate import op5_benchmark_decontamination
from bandloom.llm.filter_audit import OP13_SQL, op13_filter_audit
from bandloom.llm.jaccard_join import OP1_SQL, op1_ngram_jaccard_join
from bandloom.llm.language_id import op4_language_id
from bandloom.llm.line_dedup import OP9_SQL, op9_line_dedup
from bandloom.llm.media import op8_media_columns
from bandloom.llm.piece_bpe import op11_sentencepiece
from bandloom.llm.secrets_scan import op2_secret_scan
from bandloom.llm.shard_balance import op3_sharding
from bandloom.llm.substring_dedup import OP10_SQL, op10_substring_dedup
from bandloom.llm.token_rollup import op6_token_counts
from bandloom.llm.wand import OP12_SQL, op12_wand_search

BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows: Spark counts rows only, and texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _with_small_batches(function):
    @wraps(function)
    def run(spark, sf_dir):
        small_batches(spark)
        return function(spark, sf_dir)

    return run


QUERIES = {f.__name__: _with_small_batches(f) for f in (op1_ngram_jaccard_join, op2_secret_scan, op3_sharding, op4_language_id, op5_benchmark_decontamination, op6_token_counts, op7_byte_bpe, op8_media_columns, op9_line_dedup, op10_substring_dedup, op11_sentencepiece, op12_wand_search, op13_filter_audit)}
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op9_line_dedup": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op12_wand_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
