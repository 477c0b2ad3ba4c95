"""Fixed schemas of the engine: statement facts, function rows, change rows, scores, status."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
AS = T.ArrayType(T.StringType())

# Facts the diff rules read from one syntax node. A node is flattened to these
# columns once, inside the parse stage; nothing downstream walks a tree.
NODE = T.StructType([
    T.StructField("kind", S),
    T.StructField("text", S),
    T.StructField("test", S),
    T.StructField("body_texts", AS),
    T.StructField("orelse_n", I),
    T.StructField("orelse_texts", AS),
    T.StructField("target", S),
    T.StructField("iter", S),
    T.StructField("targets", AS),
    T.StructField("value", S),
    T.StructField("name", S),
    T.StructField("params", AS),
    T.StructField("returns", S),
    T.StructField("names", AS),
    T.StructField("module", S),
    T.StructField("handlers", AS),
    T.StructField("exc", S),
    T.StructField("decorators", AS),
    T.StructField("bases", AS),
    T.StructField("const_str", S),
    T.StructField("func_dump", S),
    T.StructField("func_text", S),
    T.StructField("args", AS),
    T.StructField("has_body", T.BooleanType()),
    T.StructField("docstring", S),
])
NODE_FIELDS = [f.name for f in NODE.fields]

# One row per function definition found in one version of one file.
FUNCTION = T.StructType([
    T.StructField("pair_id", S),
    T.StructField("version", I),
    T.StructField("func", S),
    T.StructField("walk_ord", I),
    T.StructField("args", AS),
    T.StructField("stmts", T.ArrayType(NODE)),
    T.StructField("error", S),
])

# What the parse stage gives of an item with two versions: one row with a null ``func``, which carries the parse error, if any, and what
# else the item brings along, and rows of its functions present in both versions, in three phases. A slot is a pair of statements at one
# place (``old`` is null in the added tail), an expression pair comes from inside aligned statements, a reordered statement has its
# text and both places. Nodes hold what rules read of their kinds; pairs that no rule can take have no row.
SLOT = T.StructType([
    T.StructField("pair_id", S),
    T.StructField("func", S),
    T.StructField("first_ord", I),
    T.StructField("error", S),
    T.StructField("phase", I),
    T.StructField("pos", I),
    T.StructField("old", NODE),
    T.StructField("new", NODE),
    T.StructField("statement", S),
    T.StructField("old_position", I),
    T.StructField("new_position", I),
])
PHASE_SLOT, PHASE_EXPRESSION, PHASE_REORDER = 0, 1, 2

# Union of every payload key a change record can carry.
CHANGE_PAYLOAD = T.StructType([
    T.StructField("rule", S),
    T.StructField("type", S),
    T.StructField("function", S),
    T.StructField("target", S),
    T.StructField("class", S),
    T.StructField("module", S),
    T.StructField("old", S),
    T.StructField("new", S),
    T.StructField("old_list", AS),
    T.StructField("new_list", AS),
    T.StructField("condition", S),
    T.StructField("body", AS),
    T.StructField("statement", S),
    T.StructField("old_position", I),
    T.StructField("new_position", I),
])

# Item outcomes, first failing check wins.
STATUS_OK = "ok"
STATUS_PATCH_MISSING = "patch_missing"
STATUS_NO_PATH = "no_path"
STATUS_FILE_MISSING = "file_missing"
STATUS_REPLY_MISSING = "reply_missing"
STATUS_NO_BUG = "no_bug"
STATUS_NO_DELIMITER = "no_delimiter"
STATUS_PARSE_ERROR = "parse_error"
ITEM_STATUSES = (STATUS_PATCH_MISSING, STATUS_NO_PATH, STATUS_FILE_MISSING, STATUS_REPLY_MISSING, STATUS_NO_DELIMITER, STATUS_PARSE_ERROR,
                 STATUS_NO_BUG, STATUS_OK)

# Why a score is missing.
ERROR_EMPTY_TEXT = "empty_text"
ERROR_MISSING_VECTOR = "missing_vector"
ERROR_UNEQUAL_LENGTH = "unequal_length"
ERROR_ZERO_NORM = "zero_norm"
