"""Column expressions over markup-bearing text: tokens, templates, keys and their formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text format: markup, placeholders, namespace marker, identifiers.
TOKEN = r"\\n|\$[^$\n]*\$|\[[^\]\n]*\]|£[^£\n]*£|@[A-Za-z0-9_]+!|#!|#[a-zA-Z][a-zA-Z0-9_;]*"
#: The same, faster in Java: what can't start a token is left after one look.
_TOKEN = rf"(?=[\\$\[£@#])(?:{TOKEN})"
PLACE = "⟦[TN][0-9]+⟧"
MARKER = r"(?i)(^|_)(iv2|iv_2|idea_variation_2)(_|\z)"
IDENT = r"^[A-Za-z][A-Za-z0-9_]*\z"
KINDS = ("variable", "scope", "format", "format_end", "icon", "texticon", "newline")
#: Stand-ins of a token and of a number in a skeleton, and what writes the three characters themselves in it.
TOKEN_MARK, NUMBER_MARK, ESCAPE = "\ue000", "\ue001", "\ue002"
#: Each of them as a skeleton writes it.
ESCAPED = {mark: ESCAPE + chr(ord(ESCAPE) + 1 + k) for k, mark in enumerate((ESCAPE, TOKEN_MARK, NUMBER_MARK))}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A lambda computes what it takes from outside anew for each element; a lambda's own variable is a lookup.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(v: Column) -> Column:
    """Whether nothing but Unicode white space is left."""
    return v.rlike(r"^\p{IsWhite_Space}*+\z")


def tokens(v: Column) -> Column:
    """Markup tokens in order (O-23)."""
    return F.regexp_extract_all(v, F.lit(_TOKEN), F.lit(0))


def token_kind(t: Column) -> Column:
    """Kind of one token by its text (O-24)."""
    starts = {"$": "variable", "[": "scope", "£": "icon", "@": "texticon"}
    out = F.when(t == r"\n", "newline").when(t == "#!", "format_end")
    for sign, kind in starts.items():
        out = out.when(t.startswith(sign), kind)
    return out.otherwise("format")


def token_counts(v: Column) -> Column:
    """Multiset of tokens as a map (O-25)."""
    times = lambda found, t: F.struct(t, F.size(F.filter(found, lambda x: x == t)))
    return bound(
        tokens(v), lambda found: F.map_from_entries(F.transform(F.array_distinct(found), lambda t: times(found, t)))
    )


def signature(v: Column) -> Column:
    """Sorted token counts as one string, equal exactly for equal multisets (O-26)."""
    counts = F.array_sort(F.map_entries(token_counts(v)))
    return F.array_join(F.transform(counts, lambda e: F.concat(e["key"], F.lit("\x1e"), e["value"].cast("string"))), "\x1f")


def surplus(a: Column, b: Column) -> Column:
    """Entries that a multiset has more often than another: sorted array of (token, times) (O-27)."""
    more = lambda t: F.size(F.filter(a, lambda x: x == t)) - F.size(F.filter(b, lambda x: x == t))
    rows = F.transform(F.array_sort(F.array_distinct(a)), lambda t: F.struct(t.alias("token"), more(t).alias("times")))
    return F.filter(rows, lambda r: r["times"] > 0)


def show_multiset(rows: Column) -> Column:
    """``a, b x2`` (O-39)."""
    one = lambda r: F.when(r["times"] > 1, F.concat(r["token"], F.lit(" x"), r["times"].cast("string"))).otherwise(r["token"])
    return F.array_join(F.transform(rows, one), ", ")


def describe_difference(source: Column, translation: Column) -> Column:
    """``lost ..., gained ...``; empty where the token multisets agree (O-39)."""
    part = lambda word, s: bound(s, lambda x: F.when(x != "", F.concat(F.lit(f"{word} "), x)))

    def both(t: Column) -> Column:
        a, b = t["a"], t["b"]
        shown = F.concat_ws(", ", part("lost", show_multiset(surplus(a, b))), part("gained", show_multiset(surplus(b, a))))
        # most pairs agree in order too
        return F.when(a == b, "").otherwise(shown)

    return bound(F.struct(tokens(source).alias("a"), tokens(translation).alias("b")), both)


def strip_tokens(v: Column) -> Column:
    """Text without its markup (O-28)."""
    return F.regexp_replace(v, _TOKEN, "")


def classify(v: Column) -> Column:
    """empty, prose (a letter is left without markup) or reference (O-29)."""
    return F.when(blank(v), "empty").when(strip_tokens(v).rlike(r"\p{L}"), "prose").otherwise("reference")


def skeleton(v: Column) -> Column:
    """Text with every token and number replaced by its mark: equal exactly for equal templates."""
    plain = v
    for mark, written in ESCAPED.items():
        plain = F.replace(plain, F.lit(mark), F.lit(written))
    plain = F.when(v.rlike(f"[{TOKEN_MARK}-{ESCAPE}]"), plain).otherwise(v)
    return F.regexp_replace(F.regexp_replace(plain, _TOKEN, TOKEN_MARK), "[0-9]+", NUMBER_MARK)


def class_of(skel: Column) -> Column:
    """``classify`` of a skeleton's texts, which it decides: marks are neither blank nor letters."""
    return F.when(blank(skel), "empty").when(skel.rlike(r"\p{L}"), "prose").otherwise("reference")


def _count_up(skel: Column, mark: str, letter: str) -> Column:
    label = lambda k: F.concat(F.lit(f"⟦{letter}"), k.cast("string"), F.lit("⟧"))
    parts = F.transform(F.split(skel, mark, -1), lambda text, k: F.when(k == 0, text).otherwise(F.concat(label(k), text)))
    return F.array_join(parts, "")


def template_of(skel: Column) -> Column:
    """The numbered template of a skeleton (O-30): tokens and numbers count up on their own."""
    out = _count_up(_count_up(skel, TOKEN_MARK, "T"), NUMBER_MARK, "N")

    def plain(t: Column) -> Column:
        back = t
        for mark, written in reversed(ESCAPED.items()):
            back = F.replace(back, F.lit(written), F.lit(mark))
        return F.when(F.contains(t, F.lit(ESCAPE)), back).otherwise(t)

    return bound(out, plain)


def numbers(v: Column) -> Column:
    """Digit runs outside markup, in order."""
    return F.regexp_extract_all(F.regexp_replace(v, _TOKEN, TOKEN_MARK), F.lit("[0-9]+"), F.lit(0))


def templatize(v: Column) -> Column:
    """struct<template, tokens, numbers> (O-30)."""
    return F.struct(template_of(skeleton(v)).alias("template"), tokens(v).alias("tokens"), numbers(v).alias("numbers"))


def placeholders(t: Column) -> Column:
    """Placeholders of a template in order (O-32)."""
    return F.regexp_extract_all(t, F.lit(PLACE), F.lit(0))


def detemplatize(template: Column, toks: Column, nums: Column) -> Column:
    """struct<value, ok>: placeholders filled from the lists; one out of range gives nothing and ok = false (O-31)."""
    pieces = lambda t: F.struct(
        placeholders(t).alias("marks"), F.split(t, PLACE, -1).alias("between"), toks.alias("toks"), nums.alias("nums")
    )

    def fill(mark: Column, g: Column) -> Column:
        # longer than any list: a number that doesn't fit into an int
        at = F.coalesce(F.regexp_extract(mark, "[0-9]+", 0).try_cast("int"), F.lit(0)) - 1
        return F.when(at >= 0, F.when(mark.startswith("⟦T"), F.get(g["toks"], at)).otherwise(F.get(g["nums"], at)))

    def whole(filled: Column, g: Column) -> Column:
        tail = F.transform(filled, lambda x, k: F.concat(F.coalesce(x, F.lit("")), F.get(g["between"], k + 1)))
        return F.struct(
            F.concat(F.get(g["between"], F.lit(0)), F.array_join(tail, "")).alias("value"),
            F.forall(filled, lambda x: x.isNotNull()).alias("ok"),
        )

    given = bound(template, pieces)
    return bound(given, lambda g: bound(F.transform(g["marks"], lambda m: fill(m, g)), lambda filled: whole(filled, g)))


def namespaced(key: Column) -> Column:
    """Whether a key holds the namespace marker as whole segments (O-33)."""
    return key.rlike(MARKER)


def do_not_translate(key: Column, value: Column) -> Column:
    """Whether a value is data for the engine: colours, and namespaced identifiers (O-34)."""
    return key.endswith("_color") | (value.rlike(IDENT) & namespaced(value))


def ascii_only(path: Column) -> Column:
    """Whether a path has no character beyond ASCII (O-35)."""
    return path.rlike(r"^\p{ASCII}*\z")


def key_prefix(key: Column, depth: int = 3) -> Column:
    """First segments of a key (O-38)."""
    return F.array_join(F.slice(F.split(key, "_"), 1, depth), "_")


def key_shape(key: Column) -> Column:
    """Key with its digit runs as # (O-38)."""
    return F.regexp_replace(key, "[0-9]+", "#")


def one_line(v: Column) -> Column:
    """Line breaks and tabs as blanks (O-40)."""
    return F.translate(v, "\n\r\t", "   ")


def shorten(v: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where text was cut (O-40)."""
    return F.when(F.length(v) > n, F.concat(F.left(v, F.lit(n - 1)), F.lit("…"))).otherwise(v)


def json_answer(text: Column) -> Column:
    """map<string,string> of the JSON object inside a text, null where there is none (O-41)."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>")


def quote(v: Column) -> Column:
    """Escapes bare quotes; backslash pairs stay as they are (O-15)."""
    return F.regexp_replace(v, r'\G([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)"', r'$1\\"')


def unquote(s: Column) -> Column:
    """struct<value, ok> of a text that starts with a quote (O-07)."""
    body = F.regexp_extract(s, r'\A"([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)"', 1)
    ok = s.rlike(r'\A"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"')
    return F.struct(F.when(ok, F.replace(body, F.lit('\\"'), F.lit('"'))).otherwise(F.lit("")).alias("value"), ok.alias("ok"))


def layer_of(path: Column) -> Column:
    """First path segment, ``.`` at the root (O-10)."""
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1)).otherwise(".")


def in_replace(path: Column) -> Column:
    """Whether a path lies under a replace folder (O-11)."""
    return path.contains("/replace/")


def check_pair(key: Column, source: Column, translation: Column) -> Column:
    """array<struct<rule, message>>: the invariants that a translation breaks (O-84)."""
    broken = lambda rule, message: F.struct(F.lit(rule).alias("rule"), message.alias("message"))
    leak = lambda found: F.when(F.size(found) > 0, broken("leaked-placeholder", F.concat(F.lit("placeholders left: "), F.array_join(found, " "))))
    differs = lambda d: F.when(d != "", broken("token-mismatch", F.concat(F.lit("markup differs: "), d)))
    return F.array_compact(
        F.array(
            bound(placeholders(translation), leak),
            F.when(~blank(source) & blank(translation), broken("empty-translation", F.lit("a text became empty"))),
            bound(describe_difference(source, translation), differs),
            F.when(do_not_translate(key, source) & (translation != source), broken("do-not-translate", F.lit("engine data must stay as it is"))),
        )
    )


def sound(key: Column, source: Column, translation: Column) -> Column:
    """Whether ``check_pair`` finds nothing, of texts that aren't null."""
    a, b = tokens(source), tokens(translation)
    # tokens by their order first, as most pairs agree in it
    same = (a == b) | (F.array_sort(a) == F.array_sort(b))
    kept = ~do_not_translate(key, source) | (translation == source)
    return ~translation.rlike(PLACE) & (blank(source) | ~blank(translation)) & same & kept


def fallback(key: Column, source: Column, translation: Column) -> Column:
    """The translation if it breaks nothing, else the source (O-85)."""
    return F.when(F.size(check_pair(key, source, translation)) == 0, translation).otherwise(source)
