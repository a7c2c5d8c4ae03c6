"""Source text as a relation of tokens, and the facts that follow from it by windows and groups over one file's tokens.

files(path, source, language). operators.lexer cuts sources into tokens: comments, strings, names, numbers, signs; a name in a
comment or in a string is no use, however many lines it runs over, but one in a template's `${}` is. Windows in a file's order,
joins and groups over the rows give the rest; what a name stands for and how it is used is told by operators.scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.lexer import lexed, pieces
from factloom.operators.scopes import script_uses

#: Words that begin a declaration, that stand before it, and what a declaration of each is called.
KINDS = {"function": "function", "class": "class", "interface": "interface", "type": "type_alias", "enum": "enum", "const": "variable", "let": "variable", "var": "variable", "namespace": "namespace", "fn": "function", "struct": "struct", "trait": "trait", "static": "static", "mod": "module", "impl": "impl"}
MODIFIERS = ("export", "default", "declare", "abstract", "async", "pub", "unsafe", "extern")
MEMBER_MODIFIERS = ("public", "private", "protected", "static", "readonly", "async", "abstract", "get", "set", "override", "declare", "pub", "mut", "fn", "const", "unsafe")
WITH_MEMBERS = ("class", "interface", "enum", "struct", "trait", "impl")
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "typeof", "function", "fn", "match", "await", "loop", "super", "import", "constructor")


def tokens(files: DataFrame, n: int | None = None) -> DataFrame:
    """A row for each token of code: path, language, i, text, type, offset, line (from 1), col (from 0), last_line, depth and paren (open braces
    and brackets around it), outer (the bracket around it), pair (a bracket's partner), within (all brackets around it), part (of the file), and
    text, type and line of the tokens beside it. Comments and white space are left out."""
    return lexed(files, n).filter("type <> 'comment'")


def statements(code: DataFrame) -> DataFrame:
    """tokens with stmt: the number of the top-level declaration that they are in (0 before the first)."""
    starters = (*KINDS, *MODIFIERS, "import", "use")
    alone = F.col("prev").isNull() | F.col("prev").isin(";", "}", "]") | (F.col("line") > F.col("prev_line"))
    begins = (F.col("depth") == 0) & (F.col("paren") == 0) & F.col("text").isin(*starters) & alone & ~F.coalesce(F.col("prev").isin(*MODIFIERS), F.lit(False))
    order = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return code.withColumn("stmt", F.sum(begins.cast("int")).over(order))


def declarations(stmts: DataFrame) -> DataFrame:
    """path, stmt, kind, name, is_public, is_async, line, line_end, i (its order) and places of the parts of top-level declarations."""
    top = stmts.filter("depth = 0 and paren = 0")
    t, rust = F.col("text"), F.col("language") == "rust"
    keyword = t.isin(*KINDS) & ~(F.col("next").isin("<") & (t != "impl")) & ~((t == "const") & F.col("next").isin("fn", "enum", "unsafe", "async")) & ~F.col("next").isin("=", ".", ",", ";", ":", "(", "{", "}", "[")
    by_default = (F.col("prev") == "default") | (F.col("prev") == "async") & (F.col("prev2") == "default")
    unnamed = by_default & ((t == "function") & (F.col("next").isin("(") | F.col("next").isin("*") & (F.col("next2") == "(")) | (t == "class") & F.col("next").isin("{", "extends"))
    unnamed = F.coalesce(unnamed, F.lit(False))
    keyword = keyword | unnamed
    name = F.when(unnamed, "default").when(F.col("next").isin("*", "mut"), F.col("next2")).otherwise(F.col("next"))
    at = lambda condition: F.min(F.when(condition, F.col("offset")))
    out = top.groupBy("path", "language", "stmt").agg(
        F.min_by(F.when(keyword, F.struct(t.alias("word"), name.alias("name"), F.col("i"))), F.when(keyword, F.col("i"))).alias("k"),
        F.min_by(F.struct("line", "offset"), "i").alias("first"),
        F.bool_or(t.isin("export", "pub")).alias("is_public"),
        F.bool_or(t == "async").alias("is_async"),
        F.bool_or(t == "=>").alias("arrow"),
        at((t == "(") & (F.col("prev") != "pub")).alias("open"),
        at((t == ")") & (F.col("prev2") != "(")).alias("close_filled"),
        at((t == ")") & (F.col("prev") == "(")).alias("close_empty"),
        F.min(F.when(t == "{", F.struct("offset", "line"))).alias("body"),
        F.min(F.when(t == "}", F.struct("offset", "line"))).alias("brace"),
        F.min(F.when(t == ";", F.struct("offset", "line"))).alias("semicolon"),
        F.max("last_line").alias("last"),
        F.min(F.when(t == "for", F.struct("offset", F.col("next").alias("name")))).alias("of"),
        F.min_by(F.when((F.col("type") == "name") & F.col("prev").isin("impl", ">"), t), F.when((F.col("type") == "name") & F.col("prev").isin("impl", ">"), F.col("i"))).alias("own"),
        F.min_by("text", "i").alias("head"),
    )
    end = F.least(F.col("brace"), F.col("semicolon"))
    word = F.col("k.word")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[word]
    kind = F.when(rust & (word == "const"), "const").when(word.isin("const", "let", "var") & F.col("arrow"), "function").otherwise(kind)
    kind = F.when((F.col("language") == "javascript") & (kind == "function") & F.col("is_async"), "async_function").otherwise(kind)
    named = F.when(word == "impl", F.coalesce("of.name", "own")).otherwise(F.col("k.name"))
    return out.filter("k is not null and head not in ('import', 'use')").select("path", "language", "stmt", F.col("k.i").alias("i"), word.alias("word"), kind.alias("kind"), named.alias("name"), "is_public", "is_async", F.col("first.line").alias("line"), F.coalesce(end["line"], F.col("last")).cast("int").alias("line_end"), "open", F.col("body.offset").alias("body"))


def declarators(stmts: DataFrame) -> DataFrame:
    """Rows like those of declarations for each name that a top-level const, let or var of a script declares, with what belongs to that name alone. A
    name follows the word, or a comma outside of brackets, and of angles if nothing is assigned to it; patterns have no name of their own."""
    t = F.col("text")
    top = stmts.filter("depth = 0 and paren = 0 and language <> 'rust'")
    order = Window.partitionBy("path", "stmt").orderBy("i")
    upto, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    angle = F.when(t == "<", 1).when(t == ">", -1).otherwise(0)
    last = lambda c: F.max(F.when(c, F.col("i"))).over(past)
    on = top.withColumns({
        "word_at": F.max(F.when((F.col("type") == "name") & t.isin("const", "let", "var"), F.struct("i", t.alias("word")))).over(upto), "semicolon": last(t == ";"), "angles": F.coalesce(F.sum(angle).over(past), F.lit(0)),
        "is_public": F.coalesce(F.max(t == "export").over(past), F.lit(False)),
    })
    on = on.filter("word_at is not null and coalesce(semicolon, -1) < word_at.i")
    follows = F.coalesce(F.col("prev").isin("const", "let", "var"), F.lit(False)) & (t != "enum")
    named = (F.col("type") == "name") & follows | (F.col("type") == "name") & (F.col("prev") == ",") & (F.col("next").isin("=", ":", "!") | (F.col("angles") == 0) & (F.coalesce("next", F.lit(";")).isin(",", ";") | (F.col("next").isNull())))
    pattern = t.isin("{", "[") & (follows | (F.col("prev") == ","))
    on = on.withColumn("at", F.max(F.when(named | pattern, F.col("i"))).over(upto)).filter("at is not null")
    head = F.col("i") == F.col("at")
    own = on.groupBy("path", "language", "stmt", "at").agg(
        F.max(F.when(head & named, t)).alias("name"), F.max(F.when(head, F.col("line"))).alias("line"), F.max("word_at.word").alias("word"), F.max("is_public").alias("is_public"), F.max("last_line").alias("line_end"),
        F.max((t == "=>") | (t == "function") & F.coalesce(F.col("prev").isin("=", "async"), F.lit(False))).alias("makes"), F.max((t == "async") & F.coalesce(F.col("prev") == "=", F.lit(False))).alias("is_async"),
        F.min(F.when((t == "(") & F.coalesce(F.col("prev").isin("=", "async", "function", ">"), F.lit(False)), F.col("offset"))).alias("open"), F.min(F.when(t == "{", F.col("offset"))).alias("body"),
    )
    kind = F.when(F.col("makes"), F.when((F.col("language") == "javascript") & F.col("is_async"), "async_function").otherwise("function")).otherwise("variable")
    return own.filter("name is not null").select("path", "language", "stmt", F.col("at").alias("i"), "word", kind.alias("kind"), "name", "is_public", "is_async", "line", F.col("line_end").cast("int").alias("line_end"), F.when(F.col("makes"), F.col("open")).alias("open"), "body")


def members(stmts: DataFrame, declared: DataFrame) -> DataFrame:
    """path, stmt, parent, name, kind, line, i of the members of classes, interfaces, enums, structs, traits and impls."""
    t, prev, after = F.col("text"), F.col("prev"), F.col("next")
    inside = stmts.filter("depth = 1 and paren = 0 and type = 'name'").join(declared.filter(F.col("word").isin(*WITH_MEMBERS)).select("path", "stmt", F.col("name").alias("parent"), "word"), ["path", "stmt"])
    begins = prev.isin("{", ";", ",", "}", *MEMBER_MODIFIERS) | ((F.col("line") > F.col("prev_line")) & ~prev.isin(".", ":", "|", "&", "=", "=>", "->", "?", "+", "-", "<", "extends", "new"))
    begins = begins | (prev == "*") & F.coalesce(F.col("prev2").isin("{", ";", "}", *MEMBER_MODIFIERS), F.lit(False))
    named = ~t.isin(*MEMBER_MODIFIERS) | after.isin("(", ":", "=", ";", ",")
    ends = after.isin("(", ":", "?", "=", ";", ",", "}", "<", "!", "{") | after.isNull() | (F.col("word") == "enum")
    method = after.isin("(", "<") & (F.col("word") != "enum") | (prev == "fn")
    kind = F.when(F.col("word") == "enum", F.when(F.col("language") == "rust", "variant").otherwise("member")).when(method, F.when(t == "constructor", "constructor").otherwise("method")).when(F.col("word") == "struct", "field").otherwise("property")
    body = ~F.col("word").isin("impl", "trait") | (prev == "fn")
    return inside.filter(begins & named & ends & body).select("path", "stmt", "parent", F.col("text").alias("name"), kind.alias("kind"), "line", "i")


def flattened(declared: DataFrame, within: DataFrame) -> DataFrame:
    """All symbols of a module, members after their parent: module, parent (null for declarations), name, kind, line, at (their order)."""
    top = declared.filter("word <> 'impl'").select(F.col("path").alias("module"), F.lit(None).cast("string").alias("parent"), "name", "kind", "line", F.col("i").alias("at"))
    return top.unionByName(within.select(F.col("path").alias("module"), "parent", "name", "kind", "line", F.col("i").alias("at")))


def calls(stmts: DataFrame, declared: DataFrame, within: DataFrame) -> DataFrame:
    """module, caller, callee, each once: calls by the top-level declaration they stand in; "" outside of any."""
    t = F.col("text")
    made = stmts.filter((F.col("type") == "name") & (F.col("next") == "(") & ~t.isin(*NO_CALLS, *MODIFIERS) & ~F.coalesce(F.col("prev").isin("function", "fn", "new", "*"), F.lit(False)))
    made = made.join(within.select("path", "i"), ["path", "i"], "left_anti").join(declared.select("path", "stmt", F.col("name").alias("caller"), F.col("i").alias("since")), ["path", "stmt"], "left")
    inside = (F.col("depth") > 0) & (F.col("i") > F.col("since"))
    return made.select(F.col("path").alias("module"), F.coalesce(F.when(inside, F.col("caller")), F.lit("")).alias("caller"), F.col("text").alias("callee")).distinct()


def signatures(files: DataFrame, stmts: DataFrame, declared: DataFrame) -> DataFrame:
    """module, name, signature of functions of scripts: parameters with their types, unknown where there is none, and the result, void without."""
    closes = stmts.filter("text = ')' and depth = 0 and paren = 0").select("path", "stmt", F.col("offset").alias("close"))
    f = declared.filter("word = 'function'").join(closes, ["path", "stmt"]).filter("close > open").groupBy("path", "stmt", "name", "open", "body").agg(F.min("close").alias("close"))
    params = stmts.join(f.select("path", "stmt", "open", "close"), ["path", "stmt"]).filter("offset > open and offset < close and paren = 1 and depth = 0").select("path", "stmt", "i", "text", "offset")
    angles = F.sum(F.when(F.col("text") == "<", 1).when(F.col("text") == ">", -1).otherwise(0)).over(Window.partitionBy("path", "stmt").orderBy("i"))
    cut = params.withColumn("angles", angles).filter("text = ',' and angles = 0").groupBy("path", "stmt").agg(F.array_sort(F.collect_list("offset")).alias("commas"))
    out = f.join(cut, ["path", "stmt"], "left").join(files.select("path", "source"), "path")
    text = F.concat(F.lit("export function "), "name", _printed())
    return out.select(F.col("path").alias("module"), "name", text.alias("signature"))


def _printed() -> Column:
    """Parameters and result between open and close and up to body (offsets in source), with commas between parameters (null: none). Defaults, modifiers
    and rest parameters are left out."""
    piece = lambda a, b: F.trim(F.regexp_replace(F.substring("source", a + 1, b - a), r"\s+", " "))
    ends = F.concat(F.array("open"), F.coalesce("commas", F.array().cast("array<bigint>")), F.array("close"))
    each = F.transform(F.slice(ends, F.lit(2), F.size(ends) - 1), lambda e, k: piece(F.get(ends, k) + 1, e))
    each = F.transform(F.filter(each, lambda p: (p != "") & ~p.startswith("...")), lambda p: F.regexp_replace(F.regexp_replace(p, r"\s*=(?!>).*$", ""), r"^((public|private|protected|readonly|override) )+", ""))
    shown = F.transform(each, lambda p: F.when(p.contains(":"), F.concat(F.trim(F.regexp_replace(F.substring_index(p, ":", 1), r"\?", "")), F.lit(": "), F.trim(F.regexp_replace(p, "^[^:]*:", "")))).otherwise(F.concat(F.regexp_replace(p, r"\?$", ""), F.lit(": unknown"))))
    result = F.regexp_extract(piece(F.col("close") + 1, F.col("body")), "^:(.*)$", 1)
    return F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(") -> "), F.when(result == "", "void").otherwise(F.trim(result)))


def method_signatures(files: DataFrame, stmts: DataFrame, declared: DataFrame, within: DataFrame) -> DataFrame:
    """module, owner, name, signature, line of the methods and constructors of classes of scripts: the class, then as for functions.

    A method's parameters are the tokens whose nearest bracket is its own, so a class's tokens are joined once, whatever it holds. The
    body begins with the first brace that doesn't stand in a type; without a body the result ends with the member's semicolon."""
    owners = declared.filter("word = 'class' and language <> 'rust'").select("path", "stmt")
    inside = stmts.join(owners, ["path", "stmt"]).filter("depth = 1 and paren = 0")
    t, after = F.col("text"), Window.partitionBy("path", "stmt").orderBy("i")
    ahead = after.rowsBetween(1, Window.unboundedFollowing)
    typed = F.coalesce(F.col("prev").isin(":", "|", "&", "=>", "<", ",", "is", "extends"), F.lit(False))
    stop = inside.withColumn("stops", F.min(F.when((t == ";") | (t == "{") & ~typed, F.struct("i", "offset"))).over(ahead))
    stop = stop.withColumn("paren_at", F.min(F.when(t == "(", F.struct("i", "offset", "pair"))).over(ahead))
    m = within.filter("kind in ('method', 'constructor')").select("path", "i", F.col("parent").alias("owner"), "name", "line")
    m = m.join(stop.select("path", "stmt", "i", "paren_at"), ["path", "i"]).filter("paren_at.pair >= 0").select("path", "stmt", "owner", "name", "line", F.col("paren_at.i").alias("at"), F.col("paren_at.offset").alias("open"), F.col("paren_at.pair").alias("pair"))
    closes = stop.filter("text = ')'").select("path", F.col("i").alias("pair"), F.col("offset").alias("close"), F.coalesce("stops.offset", F.col("offset") + 1).alias("body"))
    m = m.join(closes, ["path", "pair"])
    order = Window.partitionBy("path", "outer").orderBy("i")
    params = stmts.join(m.select("path", F.col("at").alias("outer")), ["path", "outer"]).select("path", "outer", "i", "text", "offset")
    angles = F.sum(F.when(F.col("text") == "<", 1).when(F.col("text") == ">", -1).otherwise(0)).over(order)
    cut = params.withColumn("angles", angles).filter("text = ',' and angles = 0").groupBy("path", F.col("outer").alias("at")).agg(F.array_sort(F.collect_list("offset")).alias("commas"))
    out = m.join(cut, ["path", "at"], "left").join(files.select("path", "source"), "path")
    return out.select(F.col("path").alias("module"), "owner", "name", F.concat("owner", F.lit("::"), "name", _printed()).alias("signature"), "line")


def uses(files: DataFrame, bound: DataFrame, targets: DataFrame) -> DataFrame:
    """target_symbol, source_symbol, file, line, col, kind of every use of a bound name.

    bound(module, local_name, exported_name, specifier), targets(module, specifier, target). Import clauses and re-exports
    are no uses, nor are properties, keys and declarations of the same name. In Rust a call counts as a use besides."""
    scripts = files.filter("language <> 'rust'")
    n = pieces(scripts)
    found = script_uses(tokens(scripts, n), bound, n).unionByName(_rust_uses(tokens(files.filter("language = 'rust'"))))
    out = found.join(bound.join(targets, ["module", "specifier"]), ["module", "local_name"])
    return out.select(F.concat_ws(":", "target", "exported_name").alias("target_symbol"), F.concat_ws(":", "module", "local_name").alias("source_symbol"), F.col("module").alias("file"), "line", "col", "kind")


def _rust_uses(code: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t, prev, after = F.col("text"), F.coalesce("prev", F.lit("")), F.coalesce("next", F.lit(""))
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("i"))).over(order), F.lit(-1))
    named = code.withColumn("_clause", last((F.col("depth") == 0) & (t == "use")) > last(t == ";")).filter("type = 'name' and not _clause")
    declared = prev.isin("const", "let", "fn", "struct", "trait", "enum", "type", "mod")
    named = named.filter(~declared & ~prev.isin(".", "::") & ~(prev.isin("{", ",") & (after == ":")))
    called = (after == "(") | (after == "::") & (F.coalesce("next3", F.lit("")) == "(")
    typed = prev.isin(":", "->", "<") | (prev == "&") & F.coalesce(F.col("prev2").isin(":", "->", "<"), F.lit(False))
    kinds = F.when(called, F.array(F.lit("Call"), F.lit("Usage"))).when(typed, F.array(F.lit("TypeReference"))).otherwise(F.array(F.lit("Usage")))
    return named.select(F.col("path").alias("module"), F.col("text").alias("local_name"), "line", "col", F.explode(kinds).alias("kind"))


def rust_bindings(files: DataFrame, clean: Column) -> DataFrame:
    """module, local_name, exported_name, specifier of crate-local use trees; globs and self are left out."""
    group = r"([\w:]*)\{([^{}]*)\}"

    def opened(tree: Column) -> Column:
        """Innermost groups are written out, as often as there are braces."""
        step = lambda acc, _: F.replace(acc, F.regexp_extract(acc, group, 0), F.array_join(F.transform(F.split(F.regexp_extract(acc, group, 2), ","), lambda x: F.concat(F.regexp_extract(acc, group, 1), F.trim(x))), ","))
        n = F.length(tree) - F.length(F.replace(tree, F.lit("{"), F.lit("")))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), tree, step)).otherwise(tree)

    trees = F.regexp_extract_all(clean, F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"), F.lit(1))
    leaves = files.filter("language = 'rust'").select(F.col("path").alias("module"), F.explode(trees).alias("tree")).withColumn("tree", F.regexp_replace("tree", r"\s*(::|[{},])\s*", "$1"))
    each = leaves.select("module", F.explode(F.split(opened(F.col("tree")), ",")).alias("leaf"))
    each = each.select("module", F.trim(F.regexp_replace("leaf", r"\s+as\s+\w+\s*$", "")).alias("name"), F.regexp_extract("leaf", r"\s+as\s+(\w+)\s*$", 1).alias("alias"))
    each = each.filter(F.col("name").rlike("^(crate|self|super)::") & ~F.col("name").rlike(r"(\*|::self)$"))
    last = F.substring_index("name", "::", -1)
    return each.select("module", F.when(F.col("alias") != "", F.col("alias")).otherwise(last).alias("local_name"), last.alias("exported_name"), F.regexp_replace("name", r"::[^:]*$", "").alias("specifier")).filter("exported_name <> ''")
