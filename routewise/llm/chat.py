"""Chat formatting: schema fingerprints select declarative mappings (DataFrame functions only).

A record's layout is the sorted list of its nested field paths; the xxhash64 of
that list is its fingerprint.  ``MAPPINGS`` gives, per layout, the paths of the
prompt, instruction and message fields; the fingerprint of every record picks
its mapping and each mapping turns its records into canonical turns
``array<struct<role,text>>``.  JSON records are fingerprinted row by row
(``turns_from_json``), with the paths of all elements of a list, typed
rows-by-turn tables by their schema (``turns_from_rows``).

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Control
strings inside texts are broken by a backslash after their first character and
backslashes are doubled, which ``unescape`` undoes exactly; roles are
percent-encoded.  ``loss_mask`` lists the code point spans of assistant texts.

Defined results: null text and role count as empty; turns of equal number are
ordered by role and text; repeated rows are repeated turns; a conversation is
one string, so its size bounds a task (a digest over a whole conversation needs
it in one value); JSON of an unknown layout or not valid JSON keeps a null
``turns`` and its fingerprint, so nothing is dropped; extra columns of a typed
table do not change the result of ``turns_from_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that steer this or another common chat template.
CONTROL = (r"<\|(?:im_start|im_end|im_sep|endoftext|begin_of_text|end_of_text|start_header_id|end_header_id|eot_id|system|user|assistant)\|>"
           r"|</?s>|\[/?INST\]|<</?SYS>>|<(?:start|end)_of_turn>")
_TURNS = "array<struct<role:string,text:string>>"

#: Layout (its field paths) -> how its fields become turns.  ``fields``: (path, role) in order,
#: paths joined with a blank line when a role lists several; ``list``: (path, role path, text path).
MAPPINGS = {
    ("prompt", "response"): {"fields": [(("prompt",), "user"), (("response",), "assistant")]},
    ("completion", "prompt"): {"fields": [(("prompt",), "user"), (("completion",), "assistant")]},
    ("answer", "question"): {"fields": [(("question",), "user"), (("answer",), "assistant")]},
    ("instruction", "output"): {"fields": [(("instruction",), "user"), (("output",), "assistant")]},
    ("input", "instruction", "output"): {"fields": [(("instruction", "input"), "user"), (("output",), "assistant")]},
    ("input", "instruction", "output", "system"): {"fields": [(("system",), "system"), (("instruction", "input"), "user"), (("output",), "assistant")]},
    ("prompt", "response", "system"): {"fields": [(("system",), "system"), (("prompt",), "user"), (("response",), "assistant")]},
    ("messages", "messages[].content", "messages[].role"): {"list": ("messages", "role", "content")},
    ("conversations", "conversations[].from", "conversations[].value"): {"list": ("conversations", "from", "value")},
    ("turns", "turns[].role", "turns[].text"): {"list": ("turns", "role", "text")},
    ("conv_id", "role", "text", "turn"): {"rows": ("conv_id", "turn", "role", "text")},
}
#: Names that other layouts give to the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths_of_json(col: Column) -> Column:
    """Sorted field paths of a JSON object: its keys, the keys of nested objects
    (``a.b``) and of all elements of nested lists (``a[].b``; ``a[]`` for one that is no object)."""
    keys = F.coalesce(F.json_object_keys(col), F.array().cast("array<string>"))

    def nested(k: Column) -> Column:
        at = F.concat(F.lit("$['"), k, F.lit("']"))
        one = F.call_function("get_json_object", col, at)
        of = lambda x: F.coalesce(F.transform(F.json_object_keys(x), lambda j: F.concat(k, F.lit("[]."), j)), F.array(F.concat(k, F.lit("[]"))))
        inner = F.when(one.startswith("["), F.array_distinct(F.flatten(F.transform(F.from_json(one, "array<string>"), of))))
        inner = inner.when(one.startswith("{"), F.transform(F.json_object_keys(one), lambda j: F.concat(k, F.lit("."), j)))
        return F.concat(F.array(k), F.coalesce(inner, F.array().cast("array<string>")))

    return F.array_sort(F.flatten(F.transform(keys, nested)))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _layout(paths) -> Column:
    return fingerprint(F.array(*[F.lit(p) for p in paths]))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _canonical(role: Column) -> Column:
    out = F.lower(role)
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, out), role)


def _message(role: str, text: str):
    return lambda m: _turn(_canonical(m[role]), m[text])


def turns_from_json(df: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``layout`` (fingerprint) and ``turns`` to rows holding one JSON record each."""
    j = F.col(record)
    field = lambda p: F.get_json_object(j, f"$['{p}']")
    turns = F.lit(None).cast(_TURNS)
    for paths, how in MAPPINGS.items():
        if "fields" in how:
            got = F.array(*[_turn(F.lit(role), F.array_join(F.filter(F.array(*[field(p) for p in names]), lambda x: x != ""), "\n\n"))
                            for names, role in how["fields"]])
        elif "list" in how:
            top, role, text = how["list"]
            got = F.transform(F.from_json(field(top), f"array<struct<`{role}`:string,`{text}`:string>>"), _message(role, text))
        else:
            continue
        turns = F.when(F.col("layout") == _layout(paths), got).otherwise(turns)
    return df.withColumn("layout", fingerprint(paths_of_json(j))).withColumn("turns", turns)


def mapping_of_rows(df: DataFrame) -> tuple[int, dict]:
    """Fingerprint of a typed table's schema (of the columns that some rows layout
    knows) and the mapping that it selects."""
    known = {p for paths, how in MAPPINGS.items() if "rows" in how for p in paths}
    layouts = [(paths, how) for paths, how in MAPPINGS.items() if "rows" in how]
    own = sorted(known.intersection(df.columns))
    got = df.sparkSession.range(1).select(*[_layout(paths).alias(f"l{i}") for i, paths in enumerate([own, *(paths for paths, _ in layouts)])]).first()
    by_print = {got[i + 1]: how for i, (_, how) in enumerate(layouts)}
    if got[0] not in by_print:
        raise ValueError(f"no rows layout for columns {df.columns}")
    return got[0], by_print[got[0]]


def turns_from_rows(df: DataFrame) -> DataFrame:
    """``(conv id, layout, turns)`` of a typed table with one row per turn; the
    fingerprint of the table's schema selects the mapping."""
    layout, how = mapping_of_rows(df)
    conv, turn, role, text = how["rows"]
    one = F.struct(F.col(turn).alias("turn"), _turn(F.col(role), F.col(text)).alias("t"))
    return (df.groupBy(F.col(conv).alias("conv_id"))
            .agg(F.array_sort(F.collect_list(one)).alias("rows"))
            .select("conv_id", F.lit(layout).cast("long").alias("layout"), F.transform("rows", lambda r: r["t"]).alias("turns")))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"(?s)(?={CONTROL})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escape_role(role: Column) -> Column:
    for plain, code in _CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def format_turns(df: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (code point start and length of every assistant text in it)."""
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    tail = f"{CLOSE}\n"
    df = df.withColumn("__p", pieces)
    formatted = F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate("__p", state, lambda s, p: F.struct(
        (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(tail)).cast("long").alias("at"),
        F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).cast("long").alias("start"),
                                                               F.length(p["body"]).cast("long").alias("length")))))
        .otherwise(s["spans"]).alias("spans")), lambda s: s["spans"])
    return df.withColumn("formatted", formatted).withColumn("loss_mask", spans).drop("__p")


def parse_formatted(formatted: Column) -> Column:
    """Turns read back from the formatted text."""
    pattern = F.lit(r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n")
    return F.transform(F.arrays_zip(F.regexp_extract_all(formatted, pattern, 1).alias("r"), F.regexp_extract_all(formatted, pattern, 2).alias("t")),
                       lambda x: F.struct(unescape_role(x["r"]).alias("role"), unescape(x["t"]).alias("text")))


def digest(df: DataFrame) -> DataFrame:
    """Checks of the formatted output, read back from ``formatted`` and ``loss_mask`` alone."""
    back = parse_formatted(F.col("formatted"))
    lines = F.array_join(F.transform("__back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(
        F.call_function("substring", F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return (df.withColumn("__back", back).withColumn("__loss", loss)
            .select("conv_id", F.size("__back").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                    F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def hostile_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns whose texts are template control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
