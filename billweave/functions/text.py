"""Text primitives: Unicode-aware regex, trimming, line handling.

Everything returns a ``Column`` built from JVM expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# white space as str.strip() sees it; Java's (?U)\s lacks U+001C to U+001F
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
# the same as regex class members, spelled out: cheaper than a Unicode property. Java asks the members of a class one
# after the other, so those beyond Latin-1, which are rare, are asked in their range only
_WIDE_BLANKS = r"\x1c-\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
BLANK_CLASS = r"\t-\r" + _WIDE_BLANKS
INLINE_BLANK = r"[\t\x0b-\r" + _WIDE_BLANKS + "]"

_META = set("[](){}.*+?|^$\\")
_QUANTIFIER = set("*?{")


def jvm_regex(pattern: str, flags: str = "Ud") -> str:
    """The same pattern for Java: Unicode classes, ``\\n`` as only line end."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        ch = pattern[i]
        pair = pattern[i:i + 2]
        if pair == r"\s":
            out.append(BLANK_CLASS if depth else f"[{BLANK_CLASS}]")
            i += 2
        elif pair == r"\S" and not depth:
            out.append(f"[^{BLANK_CLASS}]")
            i += 2
        elif ch == "\\":
            out.append(pair)
            i += 2
        else:
            depth += (ch == "[") - (ch == "]")
            out.append(ch)
            i += 1
    return f"(?{flags})" + "".join(out)


def leading_literal(pattern: str) -> str:
    """Plain text every match must start with; may be empty."""
    text = ""
    for i, ch in enumerate(pattern):
        if ch in _META:
            return text[:-1] if ch in _QUANTIFIER else text
        text += ch
    return text


def literal_alternatives(pattern: str) -> tuple[str, ...]:
    """The words of a pattern that is one group of plain words, with or without plain text behind it, else nothing."""
    group, _, tail = pattern[1:].partition(")")
    words = group.split("|")
    plain = pattern[:1] == "(" and ")" in pattern and not any(set(w) & _META for w in [*words, tail])
    return tuple(word + tail for word in words) if plain else ()


def required_words(pattern: str) -> list[tuple[str, ...]]:
    """What text must hold for the pattern to match: of each tuple, one of its words. Found are plain runs outside groups
    and classes, and a group of plain words at the start; a pattern with alternatives outside groups has none."""
    if "(?" in pattern[:2]:
        return []  # flags may change what a literal matches
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch in _META:
            if ch in _QUANTIFIER:
                run = run[:-1]
            if depth == 0 and ch == "|":
                return []
            runs, run = [*runs, run], ""
            if ch == "[":
                first = i = i + 1 + (pattern[i + 1] == "^")
                while i == first or pattern[i] != "]":
                    i += 1 + (pattern[i] == "\\")
            elif ch == "{":
                i = pattern.index("}", i)
            elif ch == "\\":
                i += 1
            depth += (ch == "(") - (ch == ")")
        elif depth == 0:
            run += ch
        i += 1
    found = [(r,) for r in dict.fromkeys([*runs, run]) if r]
    group, _, behind = pattern[1:].partition(")")
    words = literal_alternatives(f"({group})") if pattern[:1] == "(" and behind[:1] not in _QUANTIFIER else ()
    # a word that holds another one is found with it
    least = tuple(w for w in dict.fromkeys(words) if not any(o in w for o in words if o != w))
    return [least, *found] if least and "" not in least else found


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def holds(text: Column, words: list[tuple[str, ...]]) -> Column:
    """Whether the text holds one word of each tuple."""
    return reduce(Column.__and__, [contains_any(text, some) for some in words])


def _present(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column | None:
    """Whether the literal bytes are there without which nothing can match: no decoding, no regex scan."""
    words = [needs] if needs else required_words(pattern)
    return holds(text, words) if words else None


def matches(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """True where the pattern occurs anywhere; ``needs`` lists literals of which one must occur."""
    words = literal_alternatives(pattern)
    if words:
        return contains_any(text, words)
    present, test = _present(text, pattern, needs), F.rlike(text, F.lit(jvm_regex(pattern)))
    return test if present is None else present & test


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Capture of the first match, ``''`` if there is none."""
    return F.regexp_extract(text, jvm_regex(pattern), group)


def found(value: Column) -> Column:
    """Null instead of ``''``, with one evaluation of the value."""
    return F.get(F.filter(F.array(value), lambda v: v != ""), F.lit(0))


def match_value(text: Column, pattern: str, group: int = 1, needs: tuple[str, ...] = ()) -> Column:
    """Capture of the first match, null if there is none, in one scan. The group has to take a character whenever the
    pattern matches, as the groups of all pattern tables do."""
    present, value = _present(text, pattern, needs), found(capture(text, pattern, group))
    return value if present is None else F.when(present, value)


def first_capture(candidates: list[tuple[Column, str, int]]) -> Column:
    """Capture of the first (text, pattern, group) that matches, else null."""
    return F.coalesce(*[match_value(t, p, g) for t, p, g in candidates])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate an array or struct once and use it often. A plain expression that
    a lambda refers to would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def missing(text: Column) -> Column:
    return text.isNull() | (text == "")


def or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def fill(*values: Column) -> Column:
    """First non-empty value in order of precedence, else ``''``."""
    *earlier, last = values
    # the last one needs no test, which would evaluate it twice
    return F.coalesce(*[or_null(v) for v in earlier], last, F.lit(""))


def merge_label_lines(text: Column) -> Column:
    """Trim lines, drop blank ones, pull a value up to the label line before it.

    A line that ends in a label mark absorbs the next one, unless that one is a
    single character or starts with a mark. The replacement consumes the value
    line with its break, so merged lines do not chain. It starts at a break, which
    is rare, and looks back for the mark.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    return F.regexp_replace(
        F.array_join(lines, "\n"),
        r"(?Ud)\n(?<=[：:＝=，,]\n)(?![：:＝=])([^\n]{2,})(\n|\z)", " $1$2",
    )


def first_of(text: Column, words: tuple[str, ...]) -> Column:
    """1-based place where the first of some words begins, null without any."""
    # a word that begins with another one begins no earlier
    starts = [w for w in dict.fromkeys(words) if not any(w.startswith(o) for o in words if o != w)]
    # most words are absent, which a byte search tells sooner than counting characters does
    places = [F.when(F.contains(text, F.lit(w)), F.instr(text, w)) for w in starts]
    return F.least(*places) if len(places) > 1 else places[0]


def last_line(text: Column) -> Column:
    return F.substring_index(text, "\n", -1)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    """Rest behind the first line break; null if there is no break."""
    first = F.char_length(first_line(text))
    return F.when(
        first < F.char_length(text), F.substring(text, first + 2, F.char_length(text))
    )


def before_last_line(text: Column) -> Column:
    """Whole lines before the last, partial one; null if there are none."""
    cut = F.char_length(text) - F.char_length(last_line(text)) - 1
    return F.when(cut >= 0, F.substring(text, F.lit(1), cut))
