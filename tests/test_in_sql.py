"""SQL functions against the columns they are made of, NULLs included."""

import pytest
from pyspark.sql import functions as F

from eventskim.functions.in_sql import FUNCTIONS, register_functions


@pytest.mark.parametrize("function", FUNCTIONS, ids=lambda f: f.name)
def test_function_is_its_column(spark, function):
    assert function.name in register_functions(spark)
    names = [p.split()[0] for p in function.parameters.split(", ")]
    types = [p.split()[1] for p in function.parameters.split(", ")]
    rows = spark.range(4000).select(*[
        F.when(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(23)) > 0, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(61)) / (10 if t == "DOUBLE" else 1))
        .cast(t).alias(n)
        for k, (n, t) in enumerate(zip(names, types))
    ])
    both = rows.select(F.expr(f"{function.name}({', '.join(names)})").alias("sql"), function.column().alias("column")).distinct()
    found = both.collect()
    assert all(r.sql == r.column or (r.sql is None and r.column is None) for r in found) and len(found) > 1
