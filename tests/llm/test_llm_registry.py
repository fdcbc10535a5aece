"""What the subpackage registers."""

import __spark_entry__ as entry

# no SQL counterpart: models, the tokenizer's library, segmentation
ROWS_ONLY = {"op1", "op2", "op5", "op7", "op8", "op9", "op13", "pipeline"}


def test_all_operators_and_the_pipeline_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op") or n == "pipeline"}
    assert names == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert names - {n.split("_")[0] for n in entry.oracle_sql()} == ROWS_ONLY
