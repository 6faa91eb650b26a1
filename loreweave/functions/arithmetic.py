"""Arithmetic on a small grammar: numbers, names, + - * / and brackets. Nothing is ever run as code."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:,\d{3})+(?:\.\d+)?|\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)|([-+*/()]))")
#: How tightly an operator binds; ~ is a sign before a value.
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3}
# Words and signs that stand for an operator.
WORDS = [
    (r"\bdivided\s+by\b|÷", "/"), (r"\bmultiplied\s+by\b|\btimes\b|×", "*"), (r"\bminus\b|\bless\b|[−–]", "-"), (r"\bplus\b", "+"),
    (r"\b(?:the\s+)?difference\s+(?:between|of)\s+([\d.,]*\d)\s+and\s+([\d.,]*\d)", r"\1 - \2"), (r"\b(?:the\s+)?sum\s+of\s+([\d.,]*\d)\s+and\s+([\d.,]*\d)", r"\1 + \2"),
    (r"\bsubtract\s+([\d.,]*\d)\s+from\s+([\d.,]*\d)", r"\2 - \1"), (r"\b(?:the\s+)?ratio\s+of\s+([\d.,]*\d)\s+to\s+([\d.,]*\d)", r"\1 / \2"),
]


def evaluate(text: str, names: dict[str, float] | None = None) -> float | None:
    """The value of an expression, or None where it has any other sign, an unknown name, no value, or a division by zero."""
    output: list[float] = []
    waiting: list[str] = []
    operand = True  # whether a value must come next

    def apply() -> bool:
        op = waiting.pop()
        if op == "~":
            output[-1] = -output[-1]
            return True
        b = output.pop()
        a = output.pop()
        if op == "/" and b == 0:
            return False
        output.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b)
        return True

    at, text = 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        number, name, sign = m.groups()
        if number or name:
            value = float(number.replace(",", "")) if number else (names or {}).get(name)
            if not operand or value is None:
                return None
            output.append(value)
            operand = False
        elif sign == "(":
            if not operand:
                return None
            waiting.append(sign)
        elif sign == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                if not apply():
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif operand:
            if sign not in "+-":
                return None
            if sign == "-":
                waiting.append("~")
        else:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[sign]:
                if not apply():
                    return None
            waiting.append(sign)
            operand = True
    if operand:
        return None
    while waiting:
        if waiting[-1] == "(" or not apply():
            return None
    return output[0]


def spoken(question: str) -> str | None:
    """The longest expression with an operator that a question holds, its words for operators written as signs."""
    for pattern, sign in WORDS:
        question = re.sub(pattern, f" {sign} " if len(sign) == 1 else sign, question, flags=re.I)
    found = [x.strip(" +*/,.") for x in re.findall(r"[-+*/().,\d\s]{3,}", question)]
    found = [x for x in found if re.search(r"\d\s*\)*\s*[-+*/]\s*[-(]*\s*\.?\d", x)]
    return max(found, key=len, default=None)


def calculated(expression: Column, names: Column | None = None) -> Column:
    """Value of each expression; ``names`` is a map of the values that its names have. Equal expressions of a batch are worked out once."""

    @F.arrow_udf("double")
    def run(texts: pa.Array, maps: pa.Array) -> pa.Array:
        known: dict[tuple, float | None] = {}
        out = []
        for t, pairs in zip(texts.to_pylist(), maps.to_pylist(), strict=True):
            key = (t, tuple(pairs or ()))
            if key not in known:
                known[key] = None if t is None else evaluate(t, dict(pairs or ()))
            out.append(known[key])
        return pa.array(out, pa.float64())

    return run(expression, names if names is not None else F.create_map().cast("map<string,double>"))


def spoken_expression(question: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else spoken(t) for t in texts.to_pylist()], pa.string())

    return run(question)
