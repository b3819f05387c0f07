"""Python patterns in Java's syntax.

A pattern is read into Python's own parse tree and every node of the tree is written out in a form that means the
same in Java, with character classes, line ends and word characters spelled out. What has no such form, or
could exhaust Java's stack on long texts, raises :class:`Untranslatable`.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as code
from re import _parser as parser

from verdigris.functions.expr import WHITESPACE

#: Class bodies of Python's character categories: what str.isdecimal, str.isspace, and str.isalnum or "_" accept.
_CLASSES = {"digit": r"\p{Nd}", "space": "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE), "word": r"\p{L}\p{N}_"}
_WORD, _NO_WORD = f"[{_CLASSES['word']}]", f"[^{_CLASSES['word']}]"
#: What may be taken for an ASCII letter where case doesn't count.
_FOLDED = [*map(chr, range(65, 91)), *map(chr, range(97, 123)), "\u0130", "\u0131", "\u017f", "\u212a"]
#: A counted loop over more than one character takes stack for each turn in Java.
MOST_TURNS = 100


class Untranslatable(Exception):
    """The pattern has no safe form in Java."""


class JavaPattern:
    """``text`` in Java's syntax; ``groups`` counts its groups, ``always`` holds those that take part in every match."""

    def __init__(self, pattern: str):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = parser.parse(pattern)
        except (re.error, OverflowError, RecursionError) as exc:
            raise Untranslatable(str(exc)) from exc
        if tree.state.flags & (re.ASCII | re.LOCALE):
            raise Untranslatable("only Unicode matching is written out")
        self.groups = tree.state.groups - 1
        self.always: set[int] = {0}
        self.may_be_empty = tree.getwidth()[0] == 0
        self.text = self._sequence(tree, tree.state.flags, True)

    def _sequence(self, nodes, flags: int, certain: bool) -> str:
        return "".join(self._node(op, value, flags, certain) for op, value in nodes)

    def _points(self, low: int, high: int, flags: int) -> str:
        """The body of a class with these code points and, where case doesn't count, all that Python takes for them."""
        if low <= 0xDFFF and high >= 0xD800:
            raise Untranslatable("halves of surrogate pairs")
        own = f"\\x{{{low:x}}}" if low == high else f"\\x{{{low:x}}}-\\x{{{high:x}}}"
        if not flags & re.IGNORECASE:
            return own
        if high > 127:
            raise Untranslatable("case folding beyond ASCII")
        letters = re.compile(f"[{re.escape(chr(low))}-{re.escape(chr(high))}]", re.IGNORECASE)
        return own + "".join(f"\\x{{{ord(c):x}}}" for c in _FOLDED if letters.fullmatch(c) and not low <= ord(c) <= high)

    def _char(self, point: int, flags: int) -> str:
        if chr(point).isascii() and chr(point).isalnum() and not (flags & re.IGNORECASE and chr(point).isalpha()):
            return chr(point)
        return f"[{self._points(point, point, flags)}]"

    def _class(self, members, flags: int) -> str:
        negated = any(op is code.NEGATE for op, _ in members)
        held, lacked = [], []  # bodies of classes inside, and of classes whose complement is inside
        for op, value in members:
            if op is code.LITERAL:
                held.append(self._points(value, value, flags))
            elif op is code.RANGE:
                held.append(self._points(*value, flags))
            elif op is code.CATEGORY:
                body, inverted = self._category(value)
                (lacked if inverted else held).append(body)
        if len(lacked) == 1 and not held:
            return f"[{lacked[0]}]" if negated else f"[^{lacked[0]}]"
        if lacked and negated:
            raise Untranslatable("a complement of complements")
        return f"[{'^' if negated else ''}{''.join(held)}{''.join(f'[^{body}]' for body in lacked)}]"

    def _category(self, value) -> tuple[str, bool]:
        name = str(value).lower().removeprefix("category_")
        if name.removeprefix("not_") not in _CLASSES:
            raise Untranslatable(f"category {name}")
        return _CLASSES[name.removeprefix("not_")], name.startswith("not_")

    def _place(self, value, flags: int) -> str:
        lines = bool(flags & re.MULTILINE)
        places = {
            code.AT_BEGINNING: r"(?<![^\n])" if lines else r"\A",
            code.AT_BEGINNING_STRING: r"\A",
            code.AT_END: r"(?![^\n])" if lines else r"(?=\n?\z)",
            code.AT_END_STRING: r"\z",
            code.AT_BOUNDARY: f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
            code.AT_NON_BOUNDARY: rf"(?!\A\z)(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",  # never in an empty text
        }
        if value not in places:
            raise Untranslatable(f"place {value}")
        return places[value]

    def _node(self, op, value, flags: int, certain: bool) -> str:
        if op is code.LITERAL:
            return self._char(value, flags)
        if op is code.NOT_LITERAL:
            return self._class([(code.NEGATE, None), (code.LITERAL, value)], flags)
        if op is code.ANY:
            return r"[\x{0}-\x{10ffff}]" if flags & re.DOTALL else r"[^\n]"
        if op is code.IN:
            return self._class(value, flags)
        if op is code.CATEGORY:
            return self._class([(op, value)], flags)
        if op is code.AT:
            return self._place(value, flags)
        if op is code.BRANCH:
            return f"(?:{'|'.join(self._sequence(branch, flags, False) for branch in value[1])})"
        if op is code.SUBPATTERN:
            group, added, dropped, inner = value
            if added & (re.ASCII | re.LOCALE):
                raise Untranslatable("only Unicode matching is written out")
            if certain and group is not None:
                self.always.add(group)
            return f"({'?:' if group is None else ''}{self._sequence(inner, (flags | added) & ~dropped, certain)})"
        if op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
            return self._repeat(*value, {code.MAX_REPEAT: "", code.MIN_REPEAT: "?", code.POSSESSIVE_REPEAT: "+"}[op], flags, certain)
        if op in (code.ASSERT, code.ASSERT_NOT):
            direction, inner = value
            mark = ("?<" if direction < 0 else "?") + ("=" if op is code.ASSERT else "!")
            return f"({mark}{self._sequence(inner, flags, certain and op is code.ASSERT)})"
        if op is code.ATOMIC_GROUP:
            return f"(?>{self._sequence(value, flags, certain)})"
        if op is code.GROUPREF and not flags & re.IGNORECASE:
            return f"(?:\\{value})"
        raise Untranslatable(str(op))

    def _repeat(self, least: int, most, inner, greed: str, flags: int, certain: bool) -> str:
        unbounded = most is code.MAXREPEAT or most >= 2**31 - 1
        single = len(inner) == 1 and inner[0][0] in (code.LITERAL, code.NOT_LITERAL, code.ANY, code.IN, code.CATEGORY)
        if not single and (unbounded or most > MOST_TURNS or inner.getwidth()[0] == 0 and most > 1):
            raise Untranslatable("a loop over more than single characters")
        if least >= 2**31 - 1:
            raise Untranslatable("a loop beyond Java's numbers")
        body = self._sequence(inner, flags, certain and least > 0)
        times = f"{{{least},{'' if unbounded else most}}}{greed}"
        return f"{body}{times}" if single else f"(?:{body}){times}"
