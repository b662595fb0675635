"""Text and pattern column helpers.

Patterns in the configuration are written with ``\\b``. Java's ``\\b`` depends
on the JDK's idea of a letter, so ``compile_pattern`` rewrites it to ASCII
look-arounds, which is what the word lists were written against.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\w"  # Java's own is [A-Za-z0-9_], looked up in a table
_START = f"(?<!{_WORD})"
_END = f"(?!{_WORD})"
_EITHER = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_TOKEN = re.compile(r"\\.|.", re.S)


def _is_word(token: str) -> bool:
    return token in (r"\d", r"\w") or (len(token) == 1 and token.isascii() and (token.isalnum() or token == "_"))


def _opened(body: str) -> str | None:
    """Alternatives that all open with ``\\b`` and a word character, with that boundary tested once and behind the first character.

    A place where no alternative can start then costs one character test.
    """
    branches = _branches(body)
    pieces = [_TOKEN.findall(x) for x in branches]
    if not all(len(x) > 1 and x[0] == r"\b" and _is_word(x[1]) and x[1] not in (r"\d", r"\w") and x[2:3] not in (["?"], ["*"], ["+"], ["{"]) for x in pieces):
        return None
    if len(pieces) == 1:
        first = pieces[0][1]
        return f"{first}(?<!{_WORD}{first}){_bounded(pieces[0][2:], first)}"
    chars = "".join(dict.fromkeys(x[1] for x in pieces))
    return f"(?=[{chars}]){_START}(?:" + "|".join(_bounded(x[1:]) for x in pieces) + ")"


def _branches(body: str) -> list[str]:
    """The alternatives on the top level of a pattern."""
    out, depth = [""], 0
    for piece in _PIECE.findall(body):
        depth += piece.startswith("(") - (piece == ")")
        if piece == "|" and not depth:
            out.append("")
        else:
            out[-1] += piece
    return out


def _bounded(tokens: list[str], first: str = "") -> str:
    """Tokens with every ``\\b`` as a look-around; ``first`` stands before them."""
    out = []
    for i, token in enumerate(tokens):
        if token != r"\b":
            out.append(token)
            continue
        before = tokens[i - 1] if i else first
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        optional = i + 2 < len(tokens) and tokens[i + 2] in ("?", "*", "{")
        if _is_word(before):
            out.append(_END)
        elif _is_word(after) and not optional:
            out.append(_START)
        else:
            out.append(_EITHER)
    return "".join(out)


@lru_cache(maxsize=4096)
def compile_pattern(pattern: str) -> str:
    """Rewrite ``\\b`` to an ASCII word boundary."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern.removeprefix(flag)
    opened = None if "(?" in re.sub(r"\(\?:", "", body) else _opened(body)
    return flag + (opened or _bounded(_TOKEN.findall(body)))


def _best(options: list[frozenset[str]]) -> frozenset[str] | None:
    """The most selective literal set: long shortest member, few members."""
    usable = [o for o in options if o and min(map(len, o)) >= 2]
    return max(usable, key=lambda o: (min(map(len, o)), -len(o)), default=None)


#: One piece of a pattern: a look-around or group opener, a class, an escape, a repeat, or a character.
_PIECE = re.compile(r"\(\?(?:[:=!]|<[=!])|\(|\)|\||\[\^?\]?(?:\\.|[^\]])*\]|\\.|[*+?]\??|\{\d+(?:,\d*)?\}|.", re.S)
_ESCAPED_CLASS = set("bBdDsSwW")


def _alternatives(pieces: list[str]) -> frozenset[str] | None:
    """Literals of an alternation, up to its closing bracket: one set for all branches, or none."""
    branches = [_branch(pieces)]
    while pieces and pieces[0] == "|":
        pieces.pop(0)
        branches.append(_branch(pieces))
    return frozenset().union(*branches) if all(branches) else None


def _branch(pieces: list[str]) -> frozenset[str] | None:
    """The best literals that every match of one branch contains."""
    options: list[frozenset[str]] = []
    run = ""
    while pieces and pieces[0] not in "|)":
        piece = pieces.pop(0)
        inner, literal = None, ""
        if piece.startswith("("):
            inner = _alternatives(pieces)
            pieces.pop(0)  # its bracket
            if piece not in ("(", "(?:"):
                inner = None  # look-arounds match nothing themselves
        elif piece in (r"\b", r"\B", "^", "$"):
            continue
        elif piece.startswith("\\"):
            literal = "" if piece[1] in _ESCAPED_CLASS else piece[1]
        elif piece[0] != "[" and piece != ".":
            literal = piece
        repeat = pieces.pop(0) if pieces and re.fullmatch(r"[*+?]\??|\{.*\}", pieces[0]) else ""
        needed = not repeat.startswith(("*", "?", "{0"))
        if literal and needed:
            run += literal
        if not literal or repeat:  # what follows need not stand next to it
            options.append(frozenset([run.lower()] if run else []))
            run = ""
            if inner and needed:
                options.append(inner)
    options.append(frozenset([run.lower()] if run else []))
    return _best(options)


@lru_cache(maxsize=4096)
def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case strings one of which every match contains; empty if none is known."""
    found = _alternatives(_PIECE.findall(pattern.removeprefix("(?i)")))
    return tuple(sorted(found)) if found else ()


def may_match(lowered: Column, pattern: str) -> Column | None:
    """Cheap substring test that holds wherever the pattern matches."""
    out = None
    literals = required_literals(pattern)
    for literal in literals:
        if any(other != literal and other in literal for other in literals):
            continue  # where it stands, the shorter one does
        hit = F.contains(lowered, F.lit(literal))
        out = hit if out is None else out | hit
    return out


def matches(text: Column, pattern: str, lowered: Column | None = None) -> Column:
    """The pattern occurs in the text.

    With ``lowered`` (the lower-cased text) a byte-level substring test runs
    first and the pattern only where that holds, which is what keeps dictionary
    scans at scan speed.
    """
    found = text.rlike(compile_pattern(pattern))
    first = may_match(lowered, pattern) if lowered is not None else None
    return found if first is None else first & found


def trie_pattern(literals: Iterable[str]) -> str:
    """One pattern whose first group is, at every place where a literal starts, the longest literal that starts there.

    The literals become a tree of shared prefixes, so a place costs a few character tests however many there are.
    """
    literals = list(literals)
    root: dict = {}
    for literal in literals:
        node = root
        for char in literal:
            node = node.setdefault(char, {})
        node[""] = {}

    def branches(items: list[tuple[str, dict]]) -> str:
        if len(items) <= 3:
            return "|".join(escape(char) + tail(node) for char, node in items)
        half = len(items) // 2
        first = "".join(re.sub(r"([\\\]\[^&-])", r"\\\1", char) for char, _ in items[:half])
        return f"(?=[{first}])(?:{branches(items[:half])})|{branches(items[half:])}"

    def tail(node: dict) -> str:
        items = sorted((c, n) for c, n in node.items() if c)
        if not items:
            return ""
        inner = branches(items)
        if "" in node:
            return f"(?:{inner})?"
        return inner if len(items) == 1 else f"(?:{inner})"

    starts = ""
    for place in range(min(3, *map(len, literals)) if len(literals) > 1 else 0):
        # most places fail on three characters, before the tree is entered
        chars = "".join(sorted({x[place] for x in literals}))
        starts += "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", chars) + "]"
    return (f"(?={starts})" if starts else "") + f"(?=({tail(root)}))"


def _opens_words(pattern: str, literals: Iterable[str]) -> bool:
    """Every match holds one of its literals right behind ``\\b``: the pattern is that boundary and a literal, or alternatives of them."""
    body = pattern.removeprefix("(?i)")
    if body.startswith(r"\b(?:") and body.find(")") in (len(body) - 1, len(body) - 3):
        inner = body[len(r"\b(?:") : body.find(")")]
        branches = inner.split("|") if "(" not in inner else []
    else:
        branches = [x.removeprefix(r"\b") for x in body.split("|") if x.startswith(r"\b")] if not re.search(r"[(\[]", body) else []
        if len(branches) != len(body.split("|")):
            return False
    plain = [re.sub(r"\\(?![bBdDsSwW])", "", x).lower() for x in branches]
    return bool(plain) and all(any(x.startswith(literal) for literal in literals) for x in plain) and all(x[0].isalpha() for x in literals)


def quoted(value: str) -> str:
    """A string as a literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class PatternSet:
    """Many patterns looked for together.

    ``hits`` finds, in one pass over a text, which literals of any pattern occur; ``masks`` and ``marked`` turn
    them into bits, one for each pattern that may match; ``touched`` tests the bits of some patterns; ``found`` runs a pattern only where its bit is set.
    Literals that only count at the start of a word are looked for there alone. Expressions are SQL text: one
    expression of many patterns is then parsed once, where building it call by call would take seconds.
    """

    WORD = 62

    def __init__(self, patterns: Iterable[str]) -> None:
        self.patterns = list(dict.fromkeys(patterns))
        self.index = {p: i for i, p in enumerate(self.patterns)}
        own = {p: required_literals(p) for p in self.patterns}
        opening = {p for p, literals in own.items() if literals and _opens_words(p, literals)}
        self.free = sorted({x for p, literals in own.items() if p not in opening for x in literals})
        self.opening = sorted({x for p in opening for x in own[p]})
        self.literals = sorted({*self.free, *self.opening})

    def hits(self, lowered: str) -> str:
        """SQL: the literals that occur, the longest at each place."""
        parts = []
        if self.opening:
            parts.append(f"regexp_extract_all({lowered}, {quoted('(?<![a-z])' + trie_pattern(self.opening))}, 1)")
        if self.free:
            parts.append(f"regexp_extract_all({lowered}, {quoted(trie_pattern(self.free))}, 1)")
        return f"concat({', '.join(parts)})" if parts else "cast(array() as array<string>)"

    def masks(self, hits: str) -> str:
        """SQL: per hit, the bits of the patterns that may match; a hit stands for every literal it begins with."""
        bits: dict[str, list[int]] = {hit: [0] * self.words for hit in self.literals}
        for p in self.patterns:
            own = required_literals(p)
            word, bit = divmod(self.index[p], self.WORD)
            for hit in self.literals:
                if own and hit.startswith(own):
                    bits[hit][word] |= 1 << bit

        def struct(words: list[int]) -> str:
            return "named_struct(" + ", ".join(f"'m{w}', {mask}L" for w, mask in enumerate(words)) + ")"

        def lookup(some: list[str]) -> str:
            return "try_element_at(map(" + ", ".join(f"{quoted(hit)}, {struct(bits[hit])}" for hit in some) + "), hit)"

        # a map is searched from end to end, so there is one for each length of a hit
        by_length: dict[int, list[str]] = {}
        for hit in self.literals:
            by_length.setdefault(len(hit), []).append(hit)
        cases = " ".join(f"WHEN {n} THEN {lookup(some)}" for n, some in sorted(by_length.items()))
        return f"transform({hits}, hit -> CASE length(hit) {cases} END)" if cases else "cast(array() as array<struct<m0:bigint>>)"

    def marked(self, word: int, masks: str) -> str:
        """SQL: the bits of one word over all hits."""
        return f"aggregate({masks}, 0L, (bits, hit) -> bits | coalesce(hit.m{word}, 0L))"

    @property
    def words(self) -> int:
        return -(-len(self.patterns) // self.WORD)

    def touched(self, mask: str, patterns: Iterable[str]) -> str:
        """SQL: one of the patterns may match; ``mask`` names the words of bits when a number is put behind it."""
        words: dict[int, int] = {}
        for p in patterns:
            if not required_literals(p):
                return "true"
            word, bit = divmod(self.index[p], self.WORD)
            words[word] = words.get(word, 0) | 1 << bit
        return "(" + (" OR ".join(f"({mask}{w} & {bits}L) != 0" for w, bits in sorted(words.items())) or "false") + ")"

    def found(self, text: str, mask: str, pattern: str) -> str:
        """SQL: the pattern matches; ``mask`` names the words of bits when a number is put behind it."""
        found = f"rlike({text}, {quoted(compile_pattern(pattern))})"
        if not required_literals(pattern):
            return found
        word, bit = divmod(self.index[pattern], self.WORD)
        return f"(({mask}{word} & {1 << bit}L) != 0 AND {found})"


def any_of(patterns: Iterable[str]) -> str:
    """One alternation; each part keeps its own inline flags."""
    return "|".join(f"(?:{p})" for p in patterns)


def matches_any(text: Column, patterns: Iterable[str], lowered: Column | None = None) -> Column:
    out = None
    for pattern in patterns:
        hit = matches(text, pattern, lowered)
        out = hit if out is None else out | hit
    return F.lit(False) if out is None else out


def escape(value: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", value)


def phrase_pattern(phrase: str) -> str:
    """Word-bounded, case-insensitive, any white space between words."""
    return r"(?i)\b" + re.sub(r"\s+", lambda _: r"\s+", escape(phrase)) + r"\b"


def alias_pattern(alias: str) -> str:
    return r"(?i)\b" + escape(alias) + r"\b"


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(compile_pattern(pattern)), F.lit(0))


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nonblank(text: Column) -> Column:
    """Trimmed text, null when blank."""
    return F.nullif(F.trim(text), F.lit(""))


def sentences(text: Column) -> Column:
    """Sentences in order: split after . ! ? followed by white space."""
    # a single blank is left alone, so that most white space costs no replacement
    flat = F.regexp_replace(text, r"[\t\n\x0B\f\r\xa0][\s\xa0]*| [\s\xa0]+", " ")
    parts = F.transform(F.split(flat, r" (?<=[.!?] )"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def title_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def title_key(text: Column) -> Column:
    return F.concat(F.lit("title:"), title_words(text))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def evidence_text(text: Column) -> Column:
    """Lower-cased, trailing punctuation removed."""
    return F.regexp_replace(F.lower(F.trim(text)), "[.?!:;]+$", "")


def strip_markup(text: Column) -> Column:
    return F.nullif(collapse(F.regexp_replace(text, "<[^>]+>", " ")), F.lit(""))


# The five named entities and the order they are decoded in.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def decode_entities(text: Column) -> Column:
    """Markup out, named and decimal entities decoded, white space collapsed."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    # numeric entities: cut at each one and put the code point back
    parts = F.split(out, "(?=&#[0-9]+;)")
    decoded = F.transform(
        parts,
        lambda p: F.when(
            p.rlike("^&#[0-9]+;"),
            F.concat(
                code_point(F.regexp_extract(p, "^&#([0-9]+);", 1).try_cast("int")),
                F.regexp_replace(p, "^&#[0-9]+;", ""),
            ),
        ).otherwise(p),
    )
    out = F.replace(F.array_join(decoded, ""), F.lit("&amp;"), F.lit("&"))
    return collapse(out)


def code_point(code: Column) -> Column:
    """The character of a code point, through its UTF-32 bytes."""
    return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.lit(""))


def doi_bare(doi: Column) -> Column:
    return F.regexp_replace(F.trim(doi), r"(?i)^https?://doi\.org/", "")


def contains_count(text: Column, signals: Iterable[str]) -> Column:
    """How many of the signals occur as substrings."""
    hits = [F.when(F.contains(text, F.lit(s.lower())), 1).otherwise(0) for s in signals]
    total = F.lit(0)
    for hit in hits:
        total = total + hit
    return total


def words_found(text: Column, haystack: Column, min_length: int = 4) -> Column:
    """Words of ``text`` (at least ``min_length`` long) that occur in ``haystack``."""
    words = F.split(F.lower(text), r"\s+")
    return F.size(F.filter(words, lambda w: (F.length(w) >= min_length) & F.contains(haystack, w)))
