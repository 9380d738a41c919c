"""What a JSON text is read into is made once."""

from pyspark.sql import functions as F

from brightloom.functions import schemas
from brightloom.plans.ledger import ORDER_SCHEMA


def test_a_text_is_parsed_once_however_many_rules_there_are(spark):
    text = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "status": "F", "lines": [{"n": 9}]}'))
    out = spark.range(2).select(F.explode(schemas.json_problems(text, ORDER_SCHEMA)).alias("p"))
    assert [tuple(r.p) for r in out.collect()] == [("$.lines[0].n", "is out of bounds")] * 2
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") + out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
