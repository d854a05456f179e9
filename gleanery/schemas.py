"""Explicit schemas: nothing is inferred at run time."""

from pyspark.sql import types as T


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_NTZ = T.TimestampNTZType()

PAGE = _struct(
    ("id", _L), ("url", _S), ("title", _S), ("description", _S), ("content", _S),
    ("crawled_at", _NTZ), ("indexed", _B),
)
METASEARCH_RESPONSE = _struct(
    ("query", _S), ("number_of_results", _L),
    ("results", T.ArrayType(_struct(
        ("title", _S), ("url", _S), ("content", _S), ("engine", _S), ("img_src", _S),
        ("thumbnail", _S), ("publishedDate", _S), ("category", _S), ("length", _S),
    ))),
    ("suggestions", T.ArrayType(_S)),
    ("infoboxes", T.ArrayType(T.MapType(_S, _S))),
)
CHAT_SOURCES = T.ArrayType(_struct(("url", _S), ("title", _S)))
