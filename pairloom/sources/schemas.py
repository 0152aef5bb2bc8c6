"""Explicit schemas; nothing is inferred, so a hex id such as 12e4 stays text."""

from __future__ import annotations

from pyspark.sql import types as T

_string = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_int, _long, _double, _time = T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()

# The driver tables. A stated schema saves the job that reads it out of the files.
DRIVER_TABLES = {
    "region": _struct(r_regionkey=_int, r_name=_string),
    "nation": _struct(n_nationkey=_int, n_name=_string, n_regionkey=_int),
    "customer": _struct(
        c_custkey=_long, c_name=_string, c_nationkey=_int, c_acctbal=_double, c_mktsegment=_string
    ),
    "orders": _struct(
        o_orderkey=_long,
        o_custkey=_long,
        o_orderstatus=_string,
        o_totalprice=_double,
        o_orderdate=_time,
        o_orderpriority=_string,
    ),
    "events": _struct(event_id=_long, ts=_time, user_id=_long, event_type=_string, value=_double, props=_string),
    "documents": _struct(doc_id=_long, text=_string, lang=_string, source=_string, n_chars=_long),
    "embeddings": _struct(vec_id=_long, embedding=T.ArrayType(T.FloatType()), label=_int),
    "pages": _struct(page_id=_long, url=_string, html=_string),
    "benchmark": _struct(item_id=_long, text=_string),
}

PAIRS_TEST = _struct(id=_string, anchor=_string, target=_string, context=_string)
PAIRS_TRAIN = _struct(id=_string, anchor=_string, target=_string, context=_string, score=T.DoubleType())
SUBMISSION = _struct(id=_string, score=T.DoubleType())
SECTIONS = _struct(context_grp_1=_string, text_grp_1=_string)
CLASSES = _struct(context=_string, description=_string, mentioned_groups=_string)
DICTIONARY_BATCH = _struct(term=_string, mapped=_string, batch=T.LongType())
OOF = _struct(
    id=_string,
    fold=T.IntegerType(),
    score=T.DoubleType(),
    pred=T.DoubleType(),
    version=_string,
)
LEADERBOARD = _struct(model=_string, dataset=_string, score=T.DoubleType())
MARKER = _struct(best_model=_string)
