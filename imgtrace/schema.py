"""Table schemas of the catalog."""

from pyspark.sql import types as T


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STR, LONG, INT, BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
FLOAT, DOUBLE, TS = T.FloatType(), T.DoubleType(), T.TimestampType()
TAGS = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.FloatType())
CODE = T.ArrayType(T.LongType())

FEED_POST = _s(
    ("id", LONG), ("md5", STR), ("large_file_url", STR), ("file_url", STR),
    ("preview_file_url", STR), ("source", STR), ("rating", STR), ("score", INT),
    ("image_width", INT), ("image_height", INT), ("file_size", LONG), ("file_ext", STR),
    ("tag_string", STR), ("tag_string_artist", STR), ("tag_string_character", STR),
    ("tag_string_copyright", STR), ("tag_string_general", STR), ("tag_string_meta", STR),
    ("is_deleted", BOOL), ("is_banned", BOOL),
)

IMAGES = _s(
    ("image_id", LONG), ("source_site", STR), ("source_post_id", LONG), ("source_url", STR),
    ("canonical_url", STR), ("file_url", STR), ("preview_url", STR), ("md5", STR),
    ("phash", STR), ("dhash", STR), ("width", INT), ("height", INT), ("file_size", LONG),
    ("rating", STR), ("score", INT), ("tags", TAGS), ("artist_tags", TAGS),
    ("thumb_path", STR), ("indexed_by", STR), ("created_at", TS), ("updated_at", TS),
)

IMAGE_VECTORS = _s(
    ("image_id", LONG), ("model_id", STR), ("vector", VECTOR), ("created_at", TS),
    ("indexed_at", TS),
)

CODES = _s(("image_id", LONG), ("model_id", STR), ("code", CODE))

MODELS = _s(
    ("model_id", STR), ("kind", STR), ("vector_size", INT), ("distance", STR),
    ("input_size", INT), ("active", BOOL),
)

MODEL_KINDS = ("copy", "semantic")
RANGE_STATUSES = ("completed", "running", "failed", "empty")
RETRY_STATUSES = ("pending", "running", "succeeded", "dead")
