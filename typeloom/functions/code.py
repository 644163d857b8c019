"""Source-code features: one Arrow function turns a code text into token and tree facts, the rest are Column expressions.

Facts come from the interpreter's own tokenizer and parser, so they are those of its version.
Two families use them. The registered one (tier 2 and 3) has NULL wherever there is nothing to
divide by; the lexical one (names with ``lex_``) has 0.0 there, and NULL only if the code can't
be tokenized or parsed.
"""

from __future__ import annotations

import ast
import builtins
import io
import keyword
import re
import tokenize
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.prose import chars, line_features, lines, occurrences
from typeloom.functions.stats import bind, entropy, safe_ratio

RESERVED = frozenset(keyword.kwlist) | frozenset(keyword.softkwlist)
BUILTINS = frozenset(dir(builtins))
#: Control-flow words, tokens without content, words that comments may have, patterns of names in prompts.
CONTROL = RESERVED & frozenset("if elif else for while break continue try except finally raise return with yield match case".split())
STRUCTURE = (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING)
COMMENT_TERMS = ("args", "kwargs", "bool", "str", "int", "nums", "numpy", "pandas", "idx")
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
CALLED = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
ASSIGNED = r"(?m)^\s*(?:\d+\.\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*=(?!=)"

LISTS = ("names", "tokens", "keywords", "defined", "comments")
COUNTS = ("content", "plain_tokens", "control", "calls", "double_quoted", "strings", "nesting", "functions", "complexity")
FACTS = T.StructType([
    *[T.StructField(n, T.ArrayType(T.StringType())) for n in LISTS],
    *[T.StructField(n, T.IntegerType()) for n in COUNTS],
    T.StructField("indented", T.StringType()),
    T.StructField("error", T.StringType()),
])


def tokens_of(code: str) -> tuple[list[tokenize.TokenInfo], bool]:
    """The tokens up to the first error, and whether there was none."""
    found: list[tokenize.TokenInfo] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            found.append(t)
    except (tokenize.TokenError, SyntaxError):
        return found, False
    return found, True


LEAD = re.compile(r"[ \t]*")
STEPS = {tokenize.INDENT: 1, tokenize.DEDENT: -1}


def levels_by_token(tokens: list[tokenize.TokenInfo]) -> dict[int, int]:
    """Level of each line (from 1) on which a token begins: indents less dedents before its first token."""
    depths = list(accumulate(STEPS.get(t.type, 0) for t in tokens))
    return {t.start[0]: depth for t, depth in zip(reversed(tokens), reversed(depths), strict=True) if t.type not in STEPS}


def levels_by_width(leads: dict[int, str]) -> dict[int, int]:
    """Level of each line by how wide its indentation is: the rank among the different indentations."""
    widths = sorted({lead for lead in leads.values() if lead}, key=lambda lead: (len(lead), lead))
    rank = {lead: k for k, lead in enumerate(widths, 1)}
    return {n: rank.get(lead, 0) for n, lead in leads.items()}


def indented(code: str, tokens: list[tokenize.TokenInfo] | None, unit: str = "\t") -> str:
    """``code`` with one ``unit`` a level in place of its indentation; blank lines stay.

    Levels are the tokenizer's, or, for code that it doesn't take, ranks of the indentations.
    """
    rows = dict(enumerate(code.splitlines(keepends=True), 1))
    leads = {n: LEAD.match(row)[0] for n, row in rows.items() if row.strip()}
    levels = levels_by_width(leads) if tokens is None else levels_by_token(tokens)
    return "".join(unit * levels.get(n, 0) + row[len(leads[n]) :] if n in leads else row for n, row in rows.items())


def mentions(tree: ast.AST) -> Iterator[tuple[bool, str, bool]]:
    """(is an attribute, name, gives it a meaning) of every place in a program that mentions a name."""
    for node in ast.walk(tree):
        match node:
            case ast.Name(id=name, ctx=use):
                yield False, name, isinstance(use, ast.Store)
            case ast.Attribute(attr=name, ctx=use):
                yield True, name, isinstance(use, ast.Store)
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name) | ast.arg(arg=name) | ast.ExceptHandler(name=str() as name):
                yield False, name, True
            case ast.alias(name=name, asname=other):
                local = other or name.partition(".")[0]
                yield False, local, local != "*"


def defined_names(tree: ast.AST) -> list[str]:
    """Every mention of a name that the program itself gives: variables, definitions, arguments, imports,
    handlers; stored attributes and methods count where they are used as attributes."""
    every = list(mentions(tree))
    methods = {m.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, DEFS)}
    given = {(attribute, name) for attribute, name, gives in every if gives} | {(True, name) for name in methods}
    return [name for attribute, name, _ in every if (attribute, name) in given]


BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def complexities(tree: ast.AST) -> list[int]:
    """1 + branches of each function; a nested function's branches are its own."""

    def branches(node: ast.AST) -> int:
        return sum(isinstance(c, BRANCHES) + branches(c) for c in ast.iter_child_nodes(node) if not isinstance(c, DEFS))

    return [1 + branches(n) for n in ast.walk(tree) if isinstance(n, DEFS)]


def nesting(node: ast.AST, depth: int = 0) -> int:
    """Deepest nesting of control blocks; a definition starts from 0 again."""
    most = depth
    for c in ast.iter_child_nodes(node):
        most = max(most, nesting(c, 0 if isinstance(c, (*DEFS, ast.ClassDef)) else depth + isinstance(c, NESTING)))
    return most


def token_facts(found: list[tokenize.TokenInfo]) -> dict:
    content = [t for t in found if t.type not in STRUCTURE]
    names = [t.string for t in content if t.type == tokenize.NAME]
    quoted = [t.string.lstrip("rRbBuUfF") for t in content if t.type in (tokenize.STRING, tokenize.FSTRING_START)]
    before = ["", *[t.string for t in content]]
    calls = [t for t, left, right in zip(content, before, content[1:], strict=False) if t.type == tokenize.NAME and right.string == "(" and left not in ("def", "class")]
    return {
        "tokens": [t.string for t in content],
        "names": [n for n in names if n not in RESERVED and n not in BUILTINS],
        "keywords": [n for n in names if keyword.iskeyword(n)],
        "content": len(content),
        "plain_tokens": sum(t.type != tokenize.COMMENT and bool(t.string.strip()) for t in content),
        "control": sum(n in CONTROL for n in names),
        "calls": sum(t.string not in RESERVED for t in calls),
        "double_quoted": sum(q.startswith('"') for q in quoted),
        "strings": len(quoted),
    }


def facts(code: str | None, unit: str = "\t") -> dict:
    code = code or ""
    found, complete = tokens_of(code)
    out: dict = {"comments": [t.string.lstrip("#").strip() for t in found if t.type == tokenize.COMMENT]}
    out["indented"] = indented(code, found if complete else None, unit)
    if complete:
        out |= token_facts(found)
    try:
        tree = ast.parse(code)
        each = complexities(tree)
        out |= {"defined": defined_names(tree), "nesting": nesting(tree), "functions": len(each), "complexity": sum(each)}
    except (SyntaxError, ValueError, RecursionError):
        pass
    return out


def with_facts(df: DataFrame, text: str, name: str = "facts", unit: str = "\t") -> DataFrame:
    """``df`` with a struct of facts about the code in column ``text``; parts that need valid code are NULL without it.

    The text alone goes to Python; the other columns stay in the JVM. Should a fact fail in an
    unforeseen way, the row's facts are NULL and its ``error`` says why; the job goes on.
    """

    def one(code: str | None) -> dict:
        try:
            return facts(code, unit)
        except Exception as problem:  # reported row by row
            return {"error": f"{type(problem).__name__}: {problem}"}

    def told(codes: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        rows = [dict.fromkeys(FACTS.fieldNames()) | one(c) for c in codes.to_pylist()]
        return pa.array(rows, type=to_arrow_type(FACTS))

    return df.withColumn(name, F.arrow_udf(told, FACTS).asNondeterministic()(F.col(text)))


def prompt_names(prompt: Column) -> Column:
    """Identifiers that a prompt names: snake_case words, words before "(", left sides of assignments; sorted."""
    named = lambda pattern: F.regexp_extract_all(prompt, F.lit(f"(?U){pattern}"), F.lit(1))
    found = F.concat(named(f"({SNAKE})"), named(CALLED), named(ASSIGNED))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, sorted(RESERVED | BUILTINS)))))


def without_boilerplate(df: DataFrame, prompt: Column, f: str = "facts") -> DataFrame:
    """Adds own_names: the occurrences of names that the prompt doesn't give.

    The prompt's names are bound: referred to in the filter, their column is put in its place and found again for every name.
    """
    given = df.withColumn("given_names", prompt_names(F.coalesce(prompt, F.lit(""))))
    return given.withColumn("own_names", bind(F.col("given_names"), lambda names: F.filter(f"{f}.names", lambda x: ~F.array_contains(names, x))))


def _size(xs: Column) -> Column:
    return F.when(xs.isNotNull(), F.size(xs))


def _letters(xs: Column) -> Column:
    return F.aggregate(F.transform(xs, lambda x: F.length(x)), F.lit(0), lambda a, x: a + x)


def _short(xs: Column) -> Column:
    return F.size(F.filter(xs, lambda x: F.length(x) < 4))


def _hapax(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, bind(occurrences(xs), lambda n: safe_ratio(F.size(F.filter(n, lambda c: c == 1)), F.size(n))))


def _unique(xs: Column) -> Column:
    return safe_ratio(_size(F.array_distinct(xs)), _size(xs))


def code_features(f: str = "facts", prompt: Column | None = None) -> dict[str, Column]:
    """Registered code features over a facts struct; NULL where the code can't be tokenized or has no such token.

    With ``prompt``, also those relative to it; these need ``without_boilerplate`` first.
    """
    g = lambda n: F.col(f"{f}.{n}")
    out = {
        "identifier_diversity": _unique(g("names")),
        "identifier_reuse_hapax": _hapax(g("names")),
        "token_entropy": F.when(F.size(g("tokens")) > 0, bind(occurrences(g("tokens")), entropy)),
        "control_flow_keyword_ratio": safe_ratio(g("control"), g("content")),
        "function_call_density": safe_ratio(g("calls"), g("content")),
    }
    if prompt is not None:
        kept = F.col("own_names")
        some = (F.length(g("indented")) > 0) & (F.length(prompt) > 0)
        out |= {
            "identifier_diversity_no_boilerplate": _unique(kept),
            "identifier_reuse_hapax_no_boilerplate": _hapax(kept),
            "code_length_relative_to_prompt": F.when(some, safe_ratio(F.length(g("indented")), F.length(prompt))),
        }
    return {k: v.cast("double") for k, v in out.items()}


def lexical_features(text: Column, f: str = "facts") -> dict[str, Column]:
    """The lexical family over a facts struct and the code itself; 0.0 on empty, NULL on code that isn't valid."""
    g = lambda n: F.col(f"{f}.{n}")
    or_zero = lambda known, value: F.when(known.isNotNull(), F.coalesce(value, F.lit(0.0)))
    code = F.coalesce(text, F.lit(""))
    size, tokens = chars(code, spaced=True), g("plain_tokens")
    underscores = F.aggregate(F.transform(g("defined"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("_"), F.lit("")))), F.lit(0), lambda a, x: a + x)
    out = {}
    for kind, xs in (("identifier", g("defined")), ("keyword", g("keywords"))):
        out |= {
            f"lex_total_{kind}_count": _size(xs),
            f"lex_short_{kind}_ratio": F.when(tokens.isNotNull(), or_zero(xs, safe_ratio(_short(xs), tokens))),
            f"lex_{kind}_character_ratio": or_zero(xs, safe_ratio(_letters(xs), size)),
            f"lex_average_{kind}_length": or_zero(xs, safe_ratio(_letters(xs), F.size(xs))),
            f"lex_{kind}_diversity": or_zero(xs, _unique(xs)),
        }
    out |= {
        "lex_double_quote_preference_ratio": safe_ratio(g("double_quoted"), g("strings")),
        "lex_average_line_length_tokens": or_zero(tokens, safe_ratio(tokens, F.size(lines(code)))),
        "lex_average_cyclomatic_complexity": safe_ratio(g("complexity"), g("functions")),
        "lex_maximum_nesting_depth": g("nesting"),
        "lex_underscore_identifier_character_ratio": or_zero(g("defined"), safe_ratio(underscores, _letters(g("defined")))),
    }
    return {k: v.cast("double") for k, v in out.items()}


def identifier_lengths(f: str = "facts") -> Column:
    """array<struct<item int, share double>>: identifiers of each length from 1 to 20, over all tokens; 0.0 without any."""
    sizes = F.transform(F.col(f"{f}.defined"), lambda x: F.length(x))
    tokens = F.col(f"{f}.plain_tokens")
    share = lambda n, k: F.coalesce(safe_ratio(F.size(n) - F.size(F.array_remove(n, k)), tokens), F.lit(0.0))
    each = lambda n: F.array(*[F.struct(F.lit(k).alias("item"), share(n, k).alias("share")) for k in range(1, 21)])
    return F.when(F.col(f"{f}.defined").isNotNull() & tokens.isNotNull(), bind(sizes, each))


def misspelled(df: DataFrame, ids: list[str], text: Column, dictionary: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Words ([A-Za-z]+, lower-cased) that the dictionary (column word) lacks, counted by row; rows without any too.

    ``text`` is a string or an array of strings, such as the comments of a code.
    """
    parts = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    said = df.select(*ids, F.explode(parts).alias("word"))
    if allowed:
        said = said.where(~F.col("word").isin(*allowed))
    unknown = said.join(dictionary.select("word").distinct(), "word", "left_anti").groupBy(*ids).agg(F.count("*").alias("n_misspelled"))
    return df.select(*ids).distinct().join(unknown, ids, "left").select(*ids, F.coalesce("n_misspelled", F.lit(0)).alias("n_misspelled"))


def misspelled_comments(df: DataFrame, ids: list[str], dictionary: DataFrame, f: str = "facts") -> DataFrame:
    """Misspelt words in the comments of a code, usual terms of programs aside."""
    return misspelled(df, ids, F.array_join(f"{f}.comments", "\n"), dictionary, COMMENT_TERMS)


def preliminary(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """One row for each participant and session (``by``): means over the answers, NULLs left out, and the diversity
    of the identifiers of all answers together."""
    told = with_facts(df.select(*by, F.col(text).alias("code")), "code")
    lexical = lexical_features(F.col("code"))
    named = {
        "double_quote_preference_ratio": lexical["lex_double_quote_preference_ratio"],
        "average_identifier_length": lexical["lex_average_identifier_length"],
        "identifier_diversity": lexical["lex_identifier_diversity"],
        "blank_line_ratio": F.col("lines.blank_line_ratio"),
        "comment_line_ratio": F.col("lines.comment_line_ratio"),
    }
    each = told.withColumn("lines", line_features(F.coalesce("code", F.lit("")))).select(*by, *[c.alias(n) for n, c in named.items()])
    means = each.groupBy(*by).agg(F.count("*").alias("n_answers"), *[F.avg(n).alias(n) for n in named])
    names = told.select(*by, F.explode("facts.defined").alias("name")).groupBy(*by).agg(safe_ratio(F.countDistinct("name"), F.count("*")).alias("pooled_identifier_diversity"))
    return means.join(names, by, "left")
