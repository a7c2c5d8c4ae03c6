"""Items of Rust files from their tokens: parameters, results, fields, variants, generics, signatures, docs.

files(path, source, language). An item begins at its keyword and its header ends at the first brace or semicolon outside of angles, which
a running sum of opening and closing ones tells. What stands in its parentheses or braces is split at the commas outside of angles and
of further brackets. Types are shown as their tokens with blanks between.

Windows are over CHUNK tokens of a file or over an item, never over a file, so that no task holds a large one. Tables read again are joined by
merging: rows of tokens take far less room in a file than in memory, by which Spark would take them for small and send them to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.lexer import lexed, pieces
from factloom.operators.rounds import stored

#: What the keywords of items are called.
KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "const", "static": "static", "type": "type", "impl": "impl"}


#: Tokens of a file that one window holds.
CHUNK = 1 << 12


def _shown(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def read(files: DataFrame) -> DataFrame:
    """The tokens of the Rust files, comments among them, as a table: for items and unbalanced, where both are asked of the same files."""
    files = files.filter("language = 'rust'")
    return stored(lexed(files).select("path", "i", "text", "type", "line", "depth", "paren", "outer", "pair", "prev", "prev2", "prev3", "next", "next_type"), "rust-tokens")


def _latest(code: DataFrame, n: int, marks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """code with, for each name of marks(condition, value), the value at the last token up to here for which the condition holds: the last of its chunk,
    else the last of the chunks before. A file has one row for each chunk there."""
    code = code.withColumn("chunk", F.floor(F.col("i") / CHUNK))
    ends = code.groupBy("path", "chunk").agg(*[F.max(F.when(c, F.struct("i", v.alias("v")))).alias(f"_{name}") for name, (c, v) in marks.items()])
    past = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("path", "chunk", *[F.last(f"_{name}", ignorenulls=True).over(past)["v"].alias(f"_{name}") for name in marks])
    upto = Window.partitionBy("path", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    code = code.repartition(n, "path", "chunk").withColumns({name: F.last(F.when(c, v), ignorenulls=True).over(upto) for name, (c, v) in marks.items()})
    return code.join(ends.hint("merge"), ["path", "chunk"]).withColumns({name: F.coalesce(name, f"_{name}") for name in marks}).drop("chunk", *[f"_{name}" for name in marks])


def items(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """path, at (its place), kind, name, line, owner (the impl's type that a method stands in), is_public, is_async, generics, params (name, type; the
    receiver apart), receiver, result, fields, variants, aliased (what a type, constant or static is), doc. One row for each item at the top level and
    for each function in an impl block. every: read(files), if that is there already."""
    n = pieces(files.filter("language = 'rust'"))
    every = read(files) if every is None else every
    t = F.col("text")
    follows = ~F.coalesce(F.col("prev").isin(".", "::", ":", "&", "->", "<", ",", "*", "=", "+", "(", "dyn"), F.lit(False))
    named = (F.col("next_type") == "name") | (t == "impl")
    keyword = (F.col("type") == "name") & t.isin(*KINDS) & follows & named & ~((t == "const") & F.col("next").isin("fn", "unsafe", "async", "extern"))
    doc = (F.col("type") == "comment") & t.rlike("^///(?!/)|^/\\*\\*(?![*/])")
    every = every.withColumn("is_item", F.coalesce(keyword & (F.col("paren") == 0) & ((F.col("depth") == 0) | (F.col("depth") == 1) & (t == "fn")), F.lit(False)))
    every = _latest(every.filter(doc | (F.col("type") != "comment")), n, {
        "item": (F.col("is_item"), F.col("i")), "base": (F.col("is_item"), F.col("outer")), "impl": ((t == "impl") & (F.col("depth") == 0) & (F.col("type") != "comment"), F.col("i")),
        "since": ((F.col("type") == "sign") & t.isin(";", "{", "}"), F.col("i")),
    })
    # comments before the first item go on with none
    every = every.filter("item is not null or type = 'comment'").repartition(n, "path", "item")
    on = (F.col("outer") == F.col("base")) & (F.col("type") != "comment")
    level = Window.partitionBy("path", "item").orderBy("i")
    angle = lambda where: F.when(where & (t == "<"), 1).when(where & (t == ">"), -1).otherwise(0)
    every = every.withColumn("angles", F.sum(angle(on)).over(level.rowsBetween(Window.unboundedPreceding, -1)))
    every = stored(every.withColumn("angles", F.coalesce("angles", F.lit(0)) - F.when(on & (t == ">"), 1).otherwise(0)).select("path", "i", "text", "type", "line", "outer", "pair", "depth", "prev", "prev2", "prev3", "next", "item", "impl", "base", "since", "is_item", "angles"), "rust-code")
    code = every.filter("type <> 'comment'")
    on, head = F.col("outer") == F.col("base"), F.col("i") == F.col("item")
    plain = on & (F.col("angles") == 0)
    at = lambda c: F.min(F.when(c, F.col("i")))
    heads = code.groupBy("path", "item").agg(
        F.first(F.when(head, F.struct("text", "next", "line", "impl", "depth", "prev", "prev2", "prev3")), ignorenulls=True).alias("h"),
        at(plain & (t == "(")).alias("open"), at(plain & (t == "{")).alias("body"), at(plain & (t == ";")).alias("semicolon"), at(plain & (t == "=")).alias("equals"), at(plain & (t == ":")).alias("colon"), at(plain & (t == "where")).alias("where"),
        at(on & (t == "<")).alias("angle"), F.max(F.when(on & (t == ">") & (F.col("angles") == 0), F.col("i"))).alias("angle_end"),
    )
    end = F.least("body", "semicolon")
    word = F.col("h.text")
    heads = heads.withColumns({"end": F.coalesce(end, F.lit(1 << 30)), "open": F.when((word == "fn") & (F.col("open") < F.coalesce(end, F.lit(1 << 30))), F.col("open"))})
    heads = heads.withColumn("block", F.coalesce("open", F.when(word.isin("struct", "enum") & (F.col("body") == F.col("end")), F.col("body"))))
    pairs = code.filter("text in ('(', '{')").select("path", F.col("i").alias("block"), F.col("pair").alias("close"))
    heads = stored(heads.join(pairs.hint("merge"), ["path", "block"], "left"), "rust-heads")
    joined = code.repartition(n, "path", "item").join(heads.repartition(n, "path", "item").hint("merge"), ["path", "item"])
    between = lambda since, until: (F.col("i") > since) & (F.col("i") < until)
    stop = F.least("end", F.coalesce("where", F.lit(1 << 30)))
    held = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("i", "text")))), lambda x: x["text"])
    arrow = F.col("open").isNotNull() & between(F.col("close") + 1, stop)
    first_angle = (F.col("angle") == F.col("item") + 2) | (word == "impl") & (F.col("angle") == F.col("item") + 1)
    limit = F.least(F.coalesce("open", F.lit(1 << 30)), stop, F.coalesce("equals", F.lit(1 << 30)))
    whole = Window.partitionBy("path", "item")
    joined = joined.withColumns({
        "generic_end": F.min(F.when(first_angle & on & (t == ">") & (F.col("angles") == 0) & (F.col("i") < limit), F.col("i"))).over(whole),
        "for_at": F.min(F.when(plain & (t == "for") & (word == "impl") & (F.col("i") < stop), F.col("i"))).over(whole),
    })
    own = plain & (F.col("type") == "name") & between(F.coalesce("for_at", "generic_end", "item"), stop) & ~t.isin("dyn", "mut")
    parts = joined.groupBy("path", "item").agg(
        held(arrow).alias("result"),
        held(between(F.col("angle"), F.col("generic_end"))).alias("generics"),
        F.max_by("text", F.when(own, F.col("i"))).alias("self_type"),
        held(word.isin("type", "const", "static") & between(F.when(word == "type", F.col("equals")).otherwise(F.col("colon")), F.when(word == "type", F.col("semicolon")).otherwise(F.coalesce("equals", "semicolon")))).alias("aliased"),
    )
    out = heads.join(parts.hint("merge"), ["path", "item"]).join(_split(joined).hint("merge"), ["path", "item"], "left").join(_docs(every).hint("merge"), ["path", "item"], "left")
    owners = out.filter(word == "impl").select("path", F.col("item").alias("_impl"), F.col("self_type").alias("owner"))
    # what stands in no block has a key of its own, which none has
    out = out.withColumn("_impl", F.when((F.col("h.depth") == 1) & F.col("h.impl").isNotNull(), F.col("h.impl")).otherwise(-1 - F.col("item"))).join(owners.hint("merge"), ["path", "_impl"], "left")
    seen = lambda w: F.array_contains(F.array(*[F.coalesce(F.col(f"h.{p}"), F.lit("")) for p in ("prev", "prev2", "prev3")]), w)
    name = F.when(word == "impl", F.col("self_type")).when(word.isin("static", "const") & (F.col("h.next") == "mut"), F.lit(None)).otherwise(F.col("h.next"))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[word]
    some = lambda c: F.when(F.size(c) > 0, _shown(F.col(c)))
    is_fn, each = word == "fn", F.coalesce("parts", F.array().cast("array<struct<name:string,type:string,receiver:boolean,text:string>>"))
    return out.filter((F.col("h.depth") == 0) | F.col("owner").isNotNull()).select(
        "path", F.col("item").alias("at"), kind.alias("kind"), name.alias("name"), F.col("h.line").alias("line"), "owner", seen("pub").alias("is_public"), (is_fn & seen("async")).alias("is_async"), some("generics").alias("generics"),
        F.when(is_fn, F.transform(F.filter(each, lambda p: ~p["receiver"]), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type")))).alias("params"), (is_fn & F.exists(each, lambda p: p["receiver"])).alias("receiver"),
        F.when(is_fn, some("result")).alias("result"), F.when((word == "struct") & F.col("block").isNotNull(), F.transform(each, lambda p: p["name"])).alias("fields"),
        F.when((word == "enum") & F.col("block").isNotNull(), F.transform(each, lambda p: p["text"])).alias("variants"), some("aliased").alias("aliased"), "doc",
    )


def _split(joined: DataFrame) -> DataFrame:
    """path, item, parts: what stands between the commas of an item's block, in order."""
    t = F.col("text")
    content = joined.filter("block is not null and i > block and i < close")
    direct = F.col("outer") == F.col("block")
    order = Window.partitionBy("path", "item").orderBy("i")
    angle = F.when(t == "<", 1).when(t == ">", -1).otherwise(0)
    content = content.withColumn("_angles", F.coalesce(F.sum(F.when(direct, angle).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = direct & (t == ",") & (F.col("_angles") == 0)
    content = content.withColumn("n", F.coalesce(F.sum(cut.cast("int")).over(order), F.lit(0))).filter(~cut)
    rows = content.groupBy("path", "item", "n").agg(F.array_sort(F.collect_list(F.struct("i", "text", (F.col("outer") == F.col("block")).alias("direct"), "type", "outer"))).alias("ts"))
    ts = F.col("ts")
    # attributes before a part: a # and the brackets behind it
    opened = F.transform(F.filter(ts, lambda x: x["direct"] & x["text"].isin("#", "[", "]")), lambda x: x["text"])
    tail = F.when(F.get(opened, F.lit(0)) == "#", F.filter(ts, lambda x: x["i"] > F.element_at(F.filter(ts, lambda y: y["direct"] & (y["text"] == "]")), 1)["i"])).otherwise(ts)
    rows = rows.withColumn("ts", tail).filter(F.size("ts") > 0)
    colon = F.get(F.filter(ts, lambda x: x["direct"] & (x["text"] == ":")), F.lit(0))["i"]
    left = F.filter(ts, lambda x: colon.isNull() | (x["i"] < colon))
    names = F.filter(left, lambda x: x["direct"] & ~x["text"].isin("mut", "ref", "pub", "(", ")"))
    name = F.when(F.size(names) == 1, F.get(names, F.lit(0))["text"])
    kind = F.transform(F.filter(ts, lambda x: x["i"] > colon), lambda x: x["text"])
    receiver = F.exists(left, lambda x: x["direct"] & (x["text"] == "self"))
    first = F.get(F.filter(ts, lambda x: x["direct"] & (x["type"] == "name")), F.lit(0))["text"]
    part = F.struct("n", F.struct(name.alias("name"), _shown(kind).alias("type"), receiver.alias("receiver"), first.alias("text")).alias("p"))
    return rows.groupBy("path", "item").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"]).alias("parts"))


def _docs(every: DataFrame) -> DataFrame:
    """path, item, doc: the doc comments since the last brace or semicolon before an item, in one line."""
    text = F.trim(F.regexp_replace("text", r"^///|^/\*\*|\*/$", ""))
    since = F.coalesce("since", F.lit(-1)).alias("since")
    docs = every.filter("type = 'comment'").groupBy("path", since).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("line")))), lambda x: x["line"]), " ").alias("doc"))
    first = every.filter("is_item").groupBy("path", since).agg(F.min("item").alias("item"))
    return first.join(docs.hint("merge"), ["path", "since"]).select("path", "item", "doc")


def unbalanced(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """path of files with a bracket that has no partner. every: read(files), if that is there already."""
    every = lexed(files.filter("language = 'rust'")) if every is None else every
    return every.filter("type = 'sign' and text in ('(', ')', '[', ']', '{', '}') and pair < 0").select("path").distinct()


def signatures(found: DataFrame) -> DataFrame:
    """path, owner, name, kind, signature of what is public: functions and methods with their generics, parameters and result, others by their kind."""
    args = F.transform("params", lambda p: F.concat(F.coalesce(p["name"], F.lit("_")), F.lit(": "), p["type"]))
    args = F.array_join(F.when(F.col("receiver"), F.concat(F.array(F.lit("self")), args)).otherwise(args), ", ")
    generics = F.when(F.col("generics").isNotNull(), F.concat(F.lit("<"), F.regexp_replace("generics", " , ", ", "), F.lit(">"))).otherwise("")
    kind = F.col("kind")
    text = (
        F.when(kind == "function", F.concat(F.lit("pub fn "), "name", generics, F.lit("("), args, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "result"), F.lit(""))))
        .when(kind.isin("struct", "enum", "trait"), F.concat(F.lit("pub "), kind, F.lit(" "), "name", generics, F.lit(" { ... }")))
        .when(kind == "type", F.concat(F.lit("pub type "), "name", generics, F.lit(" = "), "aliased"))
        .when(kind.isin("const", "static"), F.concat(F.lit("pub "), kind, F.lit(" "), "name", F.lit(": "), "aliased"))
    )
    shown = F.when(kind == "type", "type_alias").when((kind == "function") & F.col("owner").isNotNull(), "method").otherwise(kind)
    return found.filter("is_public and kind <> 'impl'").select("path", "owner", "name", shown.alias("kind"), text.alias("signature"), "doc")
