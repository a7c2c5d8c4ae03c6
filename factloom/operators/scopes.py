"""Names by scope, and how they are used: scopes are intervals of token places, and what stands around a use decides its kind.

Tokens between two brackets form a level, and a level falls into statements and chains (a name with its calls, indexes and
members). Windows over levels tell what each bracket is: parameters, a call's arguments, a body, a literal, a pattern. A use then
meets the brackets around it by an equi-join on their places, and a declaration of the same name whose interval holds the use
hides what it would stand for outside.

Kinds follow the ancestors of a use from the inside out. A call or `new` around it ends the walk with Call or New, also where the use is
among the arguments. A variable's declaration, an arrow function or a named function ends it with the last kind met so far: TypeReference of a
type, PropertyAccess of what a member or an index is taken of, Extends of whatever stands in a class with a parent; Usage if none was.
Names behind implements, and behind the extends of an interface, are Implements and ExtendsType.

Not told apart: types that are only parts of unions behind a colon, and calls with type arguments are seen as such only where these are
one name. A function expression's own name hides nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.lexer import GOES_ON
from factloom.operators.rounds import stored

#: Words before an expression, before a bracket that is no call.
BEFORE = ("await", "case", "default", "delete", "do", "else", "export", "extends", "in", "instanceof", "new", "of", "return", "throw", "typeof", "void", "yield")
CONTROL = ("for", "if", "switch", "while", "with")
VARIABLES = ("const", "let", "var")
NAMED = ("class", "enum", "function", "interface", "namespace", "type")
FUNCTIONS = ("arrow", "named", "anonymous", "catch")
MODIFIERS = ("abstract", "async", "declare", "get", "override", "private", "protected", "public", "readonly", "set", "static", "*")


#: What levels need of tokens.
NEEDED = ("path", "part", "i", "text", "type", "line", "col", "paren", "outer", "pair", "within", "prev", "prev2", "prev3", "prev_line", "prev_type", "next", "next2")
#: What the rest needs of levels.
KEPT = (
    "path", "part", "i", "text", "type", "line", "col", "paren", "outer", "pair", "within", "prev", "prev2", "prev_type", "next", "next2", "before", "before2", "spread", "starts", "stmt", "first", "variable", "comma", "arrow", "asks", "equals",
    "class", "interface", "braced", "parent", "implements", "types", "bracket", "until", "called", "taken_of", "made", "earlier", "stops", "single_end", "method", "pattern",
)


def _is(x: Column, *values: str) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def levels(code: DataFrame) -> DataFrame:
    """tokens with what their level tells: before (the token before on the level) and after (that behind a bracket), stmt, bracket (what it is),
    until (where what is declared in it ends) and more.

    All windows are over levels (the top level by parts, see lexer._cuts), forwards or backwards: what lies in the same statement or chain is told by comparing places, which needs no
    further sort."""
    t, i, named, sign = F.col("text"), F.col("i"), F.col("type") == "name", F.col("type") == "sign"
    level = Window.partitionBy("path", "part", "outer").orderBy("i")
    back = Window.partitionBy("path", "part", "outer").orderBy(F.desc("i"))
    upto, past = level.rowsBetween(Window.unboundedPreceding, 0), level.rowsBetween(Window.unboundedPreceding, -1)
    behind = back.rowsBetween(Window.unboundedPreceding, -1)
    never = F.lit(1 << 30)
    last = lambda c: F.coalesce(F.max(F.when(c, i)).over(past), F.lit(-1))
    next_ = lambda c: F.coalesce(F.min(F.when(c, i)).over(behind), never)
    word = named & ~_is(F.col("prev"), ".")
    own_name = F.coalesce(~F.col("next").isin("(", "*", "<") | (F.col("next") == "*") & (F.col("next2") != "("), F.lit(False))
    spread = F.coalesce((F.col("prev") == ".") & (F.col("prev2") == ".") & (F.col("prev3") == "."), F.lit(False))
    ended = _is(F.col("prev_type"), "number", "string") | (F.col("prev_type") == "name") & ~_is(F.col("prev"), *BEFORE) | _is(F.col("prev"), ")", "]", "}")
    on = code.withColumns({
        "before": F.lag("text").over(level), "before2": F.lag("text", 2).over(level), "before3": F.lag("text", 3).over(level), "before_type": F.lag("type").over(level), "after": F.lead("text", 2).over(level),
        "body_end": F.lead("i", 2).over(level), "spread": spread, "ended": ended,
    })
    starts = F.col("before").isNull() | _is(F.col("before"), ";") | named & ~t.isin(*GOES_ON) & (_is(F.col("before"), "}") | (F.col("line") > F.col("prev_line")) & F.col("ended"))
    on = on.withColumn("starts", F.coalesce(starts, F.lit(False)))
    marks = {
        "variable": word & t.isin(*VARIABLES), "comma": t == ",", "arrow": t == "=>", "asks": t == "?", "equals": t == "=", "class": word & (t == "class"), "interface": word & (t == "interface"), "enum": word & (t == "enum"),
        "braced": t == "{", "opened": t == "(", "parent": word & (t == "extends"), "implements": word & (t == "implements"), "function": word & (t == "function"), "own_name": word & (t == "function") & own_name,
        "types": word & (t == "type") & (F.col("starts") | _is(F.col("before"), "export", "declare")),
    }
    on = on.withColumns({name: last(c) for name, c in marks.items()} | {"stmt": F.max(F.when(F.col("starts"), i)).over(upto), "first": F.last(F.when(F.col("starts"), t), ignorenulls=True).over(upto)})
    here = lambda name: F.when(F.col(name) >= F.col("stmt"), F.col(name)).otherwise(-1)
    on = on.withColumns({name: here(name) for name in marks} | {"next_start": next_(F.col("starts")), "next_arrow": next_(t == "=>"), "next_end": next_(t.isin(",", ";"))})
    on = on.withColumn("arrow_end", F.when(t == "=>", F.when(F.col("next") == "{", F.col("body_end")).otherwise(F.col("next_end"))))
    callee = (F.col("before_type") == "name") & ~_is(F.col("before"), *BEFORE, *CONTROL, "catch", "async", "function", *VARIABLES) | _is(F.col("before"), ")", "]") | (F.col("before") == "super")
    on = on.withColumn("callee", F.coalesce(callee | (F.col("before") == ".") & ~F.col("spread"), F.lit(False)))
    on = on.withColumn("after_type", F.coalesce((F.col("after") == ":") & (F.col("asks") < 0) & ~F.col("first").isin("case", "default"), F.lit(False)))
    paren = (
        F.when(_is(F.col("before"), *CONTROL), "control")
        .when(_is(F.col("before"), "catch"), "catch")
        .when(_is(F.col("after"), "=>") | F.col("after_type") & ~F.col("callee") & (F.col("next_arrow") < F.col("next_start")), "arrow")
        .when(F.col("function") > F.col("opened"), F.when(F.col("own_name") == F.col("function"), "named").otherwise("anonymous"))
        .when(_is(F.col("after"), "{") | F.col("after_type") & F.col("callee"), "anonymous")
        .when(F.col("callee") | _is(F.col("before"), ">") & _is(F.col("before3"), "<"), "call")
        .otherwise("group")
    )
    on = on.withColumn("bracket", F.when(sign & (t == "("), paren).when(sign & (t == "["), F.when(F.col("callee"), "index").otherwise("array")))
    # the function that a body behind a result's type belongs to, if no body stands between
    typed = F.last(F.when(F.col("bracket").isin(*FUNCTIONS) & (F.col("after") == ":"), F.struct("i", "bracket")), ignorenulls=True).over(past)
    on = on.withColumns({"typed": typed, "bracket2": F.lag("bracket", 2).over(level)})
    owner = F.when(F.col("before") == ")", F.col("bracket2")).when(F.col("typed.i") > F.greatest("braced", F.col("stmt") - 1), F.col("typed.bracket"))
    header = lambda c: (F.col(c) >= 0) & (F.col(c) > F.col("braced"))
    brace = (
        F.when(_is(F.col("before"), "=>"), "arrow")
        .when(header("class"), F.when(F.col("parent") > F.col("class"), "child").otherwise("class"))
        .when(header("interface"), "interface")
        .when(header("enum"), "enum")
        .when(owner.isin(*FUNCTIONS), owner)
        .when(_is(F.col("before"), "=", "(", ",", ":", "[", "?", "return", "default", "&", "|", "as") | F.col("before").isNull() & _is(F.col("prev"), "(", "["), "object")
        .otherwise("block")
    )
    on = on.withColumn("bracket", F.when(sign & (t == "{"), brace).otherwise(F.col("bracket")))
    member = (t == ".") & ~F.col("spread") & ~_is(F.col("next"), ".") & ~_is(F.col("prev"), ".") | (F.col("bracket") == "index")
    goes_on = member | (t == "?") & (F.col("next") == ".") | named & _is(F.col("before"), ".") & ~F.col("spread") | sign & t.isin(")", "]") | (F.col("bracket") == "call") | (t == "!") & _is(F.col("next"), ".", "(", "[")
    on = on.withColumns({"member": F.coalesce(member, F.lit(False)), "goes_on": F.coalesce(goes_on, F.lit(False)), "call": F.coalesce(F.col("bracket") == "call", F.lit(False))})
    on = on.withColumns({"chain": F.max(F.when(~F.col("goes_on"), i)).over(upto), "made": F.last(F.when(~F.col("goes_on"), F.coalesce(F.col("before") == "new", F.lit(False))), ignorenulls=True).over(upto), "last_call": last(F.col("call"))})
    near = lambda c, x: F.last(F.when(c, x), ignorenulls=True).over(behind)
    on = on.withColumns({
        "next_chain": next_(~F.col("goes_on")), "next_call": next_(F.col("call")), "next_member": next_(F.col("member")), "body": near(t == "{", F.col("pair")), "single_end": near(F.col("arrow_end").isNotNull(), F.col("arrow_end")),
        "next_bracket": F.lag("bracket").over(back),
    })
    ends = F.when(F.col("next_arrow") < F.col("next_start"), F.col("single_end"))
    until = F.when(t != "(", F.col("pair")).when(F.col("bracket") == "arrow", ends).when(F.col("bracket").isin("control", "catch", *FUNCTIONS), F.coalesce("body", "pair")).otherwise(F.col("pair"))
    return on.withColumns({
        "until": F.when(F.col("bracket").isNotNull(), until), "called": F.col("next_call") < F.col("next_chain"), "taken_of": F.col("next_member") < F.col("next_chain"), "earlier": F.col("last_call") >= F.col("chain"),
        "stops": (F.col("variable") >= 0) | (F.col("arrow") > F.col("comma")), "method": F.coalesce((F.col("next_bracket") == "anonymous") & (F.col("next") == "("), F.lit(False)),
        "pattern": F.col("bracket").isin("object", "array", "block", "index") & (_is(F.col("before"), *VARIABLES) | _is(F.col("before"), ",") & (F.col("variable") >= 0) & _is(F.col("after"), "=")),
    })


def brackets(on: DataFrame) -> DataFrame:
    """path, place and a struct of what a bracket does to the kind of a use inside: returns, sets, stops; and what is declared in it: what, until."""
    b = F.col("bracket")
    returns = F.when(b == "call", F.when(F.col("made") & ~F.col("earlier"), "New").otherwise("Call")).when(b.isin("group", "array", "object", "index") & F.col("called"), "Call")
    sets = F.when((b == "index") | b.isin("group", "array", "object") & F.col("taken_of"), "PropertyAccess").when(b == "child", "Extends")
    ends = b.isin("arrow", "named")
    what = F.struct(
        F.col("i").alias("place"), b.alias("what"), returns.alias("returns"), F.when(~ends, sets).alias("sets"), ends.alias("ends"), "stops", (F.col("types") >= 0).alias("types"),
        F.coalesce("pattern", F.lit(False)).alias("pattern"), "outer", F.when(F.col("until") >= (1 << 30), F.lit(1 << 30)).otherwise(F.col("until")).alias("until"), "before", "pair", "stmt",
    )
    return on.filter("bracket is not null or text = '${' or (text = '{' and type = 'tag')").select("path", F.col("i").alias("place"), what.alias("b"))


def around(on: DataFrame, asked: DataFrame) -> DataFrame:
    """The tokens whose name is asked(path, text) for, with the brackets around them (b), outermost first."""
    uses = on.filter("type = 'name'").join(asked, ["path", "text"], "left_semi")
    inside = uses.select("path", "i", F.explode("within").alias("place")).join(brackets(on), ["path", "place"])
    held = inside.groupBy("path", "i").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return uses.join(held, ["path", "i"], "left")


def locals_(uses: DataFrame) -> DataFrame:
    """path, part, text, since, until: what is declared below the top level under an asked name, and the places where it holds."""
    b, n = F.col("b"), F.coalesce(F.size("b"), F.lit(0))
    inner = F.try_element_at(b, F.lit(-1))
    prev, after, before = F.col("prev"), F.col("next"), F.col("before")
    params = F.coalesce(inner["what"].isin(*FUNCTIONS), F.lit(False))
    starts_item = before.isNull() | before.isin(",", *MODIFIERS) | F.col("spread")
    is_param = params & starts_item & after.isin(",", ")", ":", "=", "?") & F.coalesce(F.col("paren") > 0, F.lit(False))
    is_variable = _is(before, *VARIABLES) | _is(before, ",") & (F.col("variable") >= 0) & (F.col("arrow") < F.col("variable")) & _is(after, "=", ",", ";", ":", "of", "in")
    is_named = _is(before, *NAMED) & ~_is(F.col("before2"), "=", "(", ",", "return", ":", "=>")
    is_single = _is(after, "=>")
    end = F.lit(1 << 30)
    outer_end = F.coalesce(inner["until"], end)
    # a pattern, or parameters, may hold literals within literals; a name in them is declared unless it is a key or a default
    root = F.try_element_at(F.filter(b, lambda x: x["pattern"]), F.lit(-1))
    fn = F.try_element_at(F.filter(b, lambda x: x["what"].isin(*FUNCTIONS) & (x["pair"] > F.col("i"))), F.lit(-1))
    deeper = lambda r: F.forall(F.filter(b, lambda x: x["place"] > r["place"]), lambda x: x["what"].isin("object", "array", "block", "index"))
    binds = after.isin(",", "}", "]", "=") & (prev.isin("{", "[", ",", ":") | F.col("spread")) & (F.col("equals") <= F.col("comma"))
    outside = F.try_element_at(F.filter(b, lambda x: x["place"] < root["place"]), F.lit(-1))
    in_pattern = root.isNotNull() & deeper(root) & binds
    within_fn = F.try_element_at(F.filter(b, lambda x: x["place"] > fn["place"]), F.lit(1))["before"]
    in_params = fn.isNotNull() & (fn["place"] != inner["place"]) & deeper(fn) & binds & (within_fn.isNull() | (within_fn == ","))
    hold = lambda s, u: F.struct(F.coalesce(s, F.lit(-1)).cast("int").alias("since"), F.coalesce(u, end).cast("int").alias("until"))
    span = (
        F.when(is_param, hold(inner["place"], inner["until"]))
        .when(F.coalesce(in_pattern, F.lit(False)), hold(outside["place"], outside["until"]))
        .when(F.coalesce(in_params & _is_paren(fn), F.lit(False)), hold(fn["place"], fn["until"]))
        .when(is_variable | is_named, hold(inner["place"], outer_end))
        .when(is_single, hold(F.col("i"), F.coalesce(F.col("single_end"), end)))
    )
    # at the top level a name is declared beside the import only where it is no import: such a file has no use of the import
    return uses.withColumn("span", span).filter("span is not null").filter((n > 0) | is_single).select("path", "part", "text", "span.since", "span.until")


def _is_paren(x: Column) -> Column:
    return x["before"].isNull() | (x["before"] != "=>")


def _visible(found: DataFrame, hidden: DataFrame) -> DataFrame:
    """found without what stands within a span of hidden of its name. Spans that end do so within their part: there a running count of those that are
    open tells, in the order of places, so that no use meets each span. Of spans without an end the first of a file counts."""
    never = F.lit(1 << 30)
    ends = hidden.filter((F.col("until") < never) & (F.col("since") <= F.col("until")))
    sides = F.array(F.struct(F.col("since").alias("i"), F.lit(1).alias("_opens")), F.struct((F.col("until") + 1).alias("i"), F.lit(-1).alias("_opens")))
    sides = ends.select("path", "part", "text", F.explode(sides).alias("e")).select("path", "part", "text", "e.*")
    upto = Window.partitionBy("path", "part", "text").orderBy("i", F.col("_opens") == 0)
    open_ = F.sum("_opens").over(upto)
    left = found.withColumn("_opens", F.lit(0)).unionByName(sides, allowMissingColumns=True).withColumn("_open", open_).filter("_opens = 0 and _open = 0").drop("_opens", "_open")
    lasting = hidden.filter(F.col("until") >= never).groupBy("path", "text").agg(F.min("since").alias("_from"))
    return left.join(lasting, ["path", "text"], "left").filter("_from is null or i < _from").drop("_from")


def script_uses(code: DataFrame, bound: DataFrame, n: int | None = None) -> DataFrame:
    """module, local_name, line, col, kind of every use of a bound(module, local_name) name in scripts; clauses of imports and re-exports, keys,
    members and attributes are no uses, nor are names that a closer declaration hides."""
    kept = (F.col("type") == "name") | F.col("bracket").isNotNull() | (F.col("text") == "${") | (F.col("text") == "{")
    code = code.select(*NEEDED)
    code = code if n is None else code.repartition(n, "path", "part")
    on = stored(levels(code).filter(kept).select(*KEPT), "levels")
    asked = bound.select(F.col("module").alias("path"), F.col("local_name").alias("text")).distinct()
    uses = stored(around(on, asked), "uses")  # both the uses and what hides them are found among these
    prev, after, before = F.coalesce("prev", F.lit("")), F.coalesce("next", F.lit("")), F.coalesce("before", F.lit(""))
    inner = F.try_element_at("b", F.lit(-1))
    what = F.coalesce(inner["what"], F.lit("file"))
    member_of = what.isin("class", "child", "interface", "enum", "object")
    # members of classes and interfaces, and keys and methods of literals
    key = (what.isin("object", "block", "index", "array") & prev.isin("{", ",") & (after == ":")) | (what == "enum") & prev.isin("{", ",")
    begins = F.col("starts") | before.isin(*MODIFIERS) | (what == "object") & (before == ",")
    own = member_of & begins & (F.col("method") | what.isin("class", "child", "interface") & after.isin(":", "=", ";", "?", "!", "}"))
    froms = on.filter("outer < 0 and (first = 'import' and i = stmt and next not in ('(', '.') or first = 'export' and text = 'from')").groupBy("path", "stmt").agg(F.lit(True).alias("imports"))
    # the statement of the top level that a use stands in
    uses = uses.withColumn("_stmt", F.when(F.size("within") > 0, F.get("b", F.lit(0))["stmt"]).otherwise(F.col("stmt")))
    uses = uses.join(froms.withColumnRenamed("stmt", "_stmt"), ["path", "_stmt"], "left")
    skipped = F.coalesce("imports", F.lit(False)) & (F.size("within") <= 1) | _is(F.col("prev"), "as") & F.coalesce(inner["before"] == "export", F.lit(False))
    property_ = (before == ".") & ~F.col("spread") | (prev == ".") & ~F.col("spread")
    found = uses.filter(~skipped & ~property_ & ~key & ~own & ~_is(F.col("before"), *NAMED))
    hidden = locals_(uses)

    asks = (F.col("asks") < 0) | _is(F.col("prev2"), "?")
    annotated = (prev == ":") & (_is(F.col("prev2"), ")") | asks & ~what.isin("object", "call", "group", "array", "index") & ~F.col("first").isin("case", "default"))
    generic = (prev == "<") & (F.col("prev_type") != "tag") & after.isin(">", ",", "|", "&", "[", "extends") & ~(after.isin("|", "&") & F.coalesce(F.col("next2") == after, F.lit(False))) | (prev == ",") & (after == ">")
    typed = prev.isin("as", "satisfies", "is", "keyof") | annotated | generic | (F.col("types") >= 0) | F.coalesce(F.exists("b", lambda x: x["types"]), F.lit(False))
    header = (F.col("class") >= 0) & (F.col("class") > F.col("braced"))
    state = lambda kind, done: F.struct(kind.alias("kind"), done.alias("done"))
    lit = lambda x: F.lit(x).cast("string")
    first = (
        F.when(F.col("made") & (before == "new"), state(lit("New"), F.lit(True)))
        .when(F.col("called") & ~typed, state(lit("Call"), F.lit(True)))
        .when(header & (F.col("implements") > F.col("class")), state(lit("Implements"), F.lit(True)))
        .when((F.col("interface") > F.col("braced")) & (F.col("parent") > F.col("interface")), state(lit("ExtendsType"), F.lit(True)))
        .when(header & (F.col("parent") > F.col("class")), state(lit("Extends"), F.col("stops")))
        .when(typed, state(lit("TypeReference"), F.col("stops")))
        .when(F.col("taken_of"), state(lit("PropertyAccess"), F.col("stops")))
        .otherwise(state(lit("Usage"), F.col("stops")))
    )

    def step(s: Column, x: Column) -> Column:
        inward = F.when(x["returns"].isNotNull(), state(x["returns"], F.lit(True))).otherwise(state(F.coalesce(x["sets"], s["kind"]), x["ends"] | x["stops"]))
        return F.when(s["done"], s).otherwise(inward)

    kind = F.aggregate(F.reverse(F.coalesce("b", F.array().cast(found.schema["b"].dataType))), first, step)["kind"]
    found = _visible(found.select("path", "part", "text", "i", "line", "col", kind.alias("kind")), hidden)
    return found.select(F.col("path").alias("module"), F.col("text").alias("local_name"), "line", "col", "kind")
