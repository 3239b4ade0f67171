r"""Formulas of answers: two plain forms, and equality of expressions over rational numbers, roots and letters.

An expression is a quotient of two polynomials whose coefficients are rational and whose
terms carry a square root of a square-free number and powers of names. Two expressions
are equal if their cross products are the same polynomial, so no algebra library is needed.
"""

from __future__ import annotations

import re
from fractions import Fraction

# What the literal form leaves out or rewrites, in order.
_LITERAL = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
# Units and number words of the evaluated form, and words that LaTeX commands stand for.
_UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard"]
_WORDS = [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
_COMMANDS = {"pi": "pi", "infty": "inf", "cup": "U", "cdot": "*", "times": "*", "div": "/", "pm": "±", "circ": "", "left": "", "right": "", "ldots": "...", "dots": "..."}
# Substitutions and words that the whole-number form leaves out.
_FINAL = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
_FINAL_DROPPED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots", "<|im_end|>", "<|endoftext|>",
]


def _replaced(text: str, pairs) -> str:
    for old, new in pairs:
        text = text.replace(old, new)
    return text


def literal_form(answer: str | None) -> str | None:
    """A form in which equal answers are mostly equal texts: units off, fractions and roots in braces, no spaces."""
    if answer is None:
        return None
    whole = answer.strip()
    held = re.search(r"^\\text\{(.+?)\}$", whole)
    text = whole = held[1].strip() if held else whole
    text = _replaced(text, _LITERAL)
    head, *units = text.split("\\text{ ")
    if len(units) > 1:
        return whole
    text = _replaced(head, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    if text.startswith("."):
        text = "0" + text
    left, *right = text.split("=")
    if len(right) == 1 and len(left) <= 2:
        text = right[0]
    if text.endswith("\\sqrt"):
        return whole
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text).replace(" ", "")
    if not re.search(r"\\frac[^{]?$", text):
        text = re.sub(r"\\frac([^{])(?:(?=\{)|(.))", lambda m: f"\\frac{{{m[1]}}}" + (f"{{{m[2]}}}" if m[2] else ""), text)
    if text == "0.5":
        return "\\frac{1}{2}"
    ratio = re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", text)
    return f"\\frac{{{ratio[1]}}}{{{ratio[2]}}}" if ratio else text


def _plain_latex(text: str) -> str:
    """Without commands: a fraction's parts around a slash (not in brackets), roots in brackets."""
    text = re.sub(r"\\[td]?frac", r" \\frac", text)
    inner = r"((?:[^{}]|\{[^{}]*\})*)"
    for _ in range(8):
        now = re.sub(rf"\\frac\s*\{{{inner}\}}\s*\{{{inner}\}}", r"\1/\2", text)
        now = re.sub(rf"\\sqrt\s*\{{{inner}\}}", r"sqrt(\1)", now)
        now = re.sub(rf"\\(?:text|mathrm|mathbf|textbf|mbox|operatorname)\s*\{{{inner}\}}", r"\1", now)
        if now == text:
            break
        text = now
    text = re.sub(r"\\frac\s*(\w)\s*(\w)", r"\1/\2", text)
    text = re.sub(r"\\sqrt\s*(\w)", r"sqrt(\1)", text)
    text = re.sub(r"\\([A-Za-z]+)", lambda m: _COMMANDS.get(m[1], m[1]), text)
    return _replaced(text, [("\\{", "{"), ("\\}", "}"), ("\\,", " "), ("\\;", " "), ("\\!", ""), ("\\ ", " "), ("√", "sqrt"), ("π", "pi"), ("∞", "inf"), ("∪", "U"), ("·", "*"), ("×", "*")]).strip()


def _no_commas(text: str) -> str:
    """Numbers without the commas between their thousands."""
    return re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", text)


def _whole(text: str) -> int | None:
    """The whole number that a text is, as near as 1e-7."""
    try:
        x = float(_no_commas(text))
        return int(round(x)) if abs(x - round(x)) <= 1e-7 else None
    except (ValueError, OverflowError):
        return None


def evaluated_form(answer: str | None) -> str | None:
    """The form that is evaluated: no units, commands or spaces, mixed numbers as sums, lower case."""
    if answer is None:
        return None
    held = re.search(r"^\\text\{(.+?)\}$", answer)
    text = _replaced(held[1] if held else answer, _WORDS)
    for unit in _UNITS:
        text = re.sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "", text)
    text = re.sub(r"\^ *\\circ", "", text)
    if text[:1] == "{" and text[-1:] == "}":
        text = text[1:-1]
    text = re.sub(r",\\! *", "", text)
    try:
        number = float(text)
        text = str(int(round(number))) if abs(number - round(number)) <= 1e-7 else text
    except (ValueError, OverflowError):
        pass
    text = _plain_latex(text) if "\\" in text else text
    text = re.sub(r"([0-9]) +([0-9])", r"\1+\2", re.sub("- *", "-", text))
    text = re.sub(r"[ {}]", "", text).lower()
    number = _whole(text)
    return text if number is None else str(int(float(text.replace(",", ""))))


#: Products of more terms are not evaluated.
MOST_TERMS = 20_000
#: A polynomial: for each term (root, ((name, power), ...)) its coefficient.
_ONE = (1, ())


def _plus(a: dict, b: dict, sign: int = 1) -> dict:
    out = dict(a)
    for term, c in b.items():
        out[term] = out.get(term, 0) + sign * c
    return {t: c for t, c in out.items() if c}


def _free_of_squares(n: int) -> tuple[int, int]:
    """n as square factor's root and the rest."""
    out, k = 1, 2
    while k * k <= n and k < 10_000:
        while n % (k * k) == 0:
            n, out = n // (k * k), out * k
        k += 1
    return out, n


def _times(a: dict, b: dict) -> dict:
    if len(a) * len(b) > MOST_TERMS:
        raise ValueError("too many terms")
    out: dict = {}
    for (r, names), c in a.items():
        for (s, others), d in b.items():
            root, rest = _free_of_squares(r * s) if r > 0 and s > 0 else (1, r * s)
            powers = dict(names)
            for name, p in others:
                powers[name] = powers.get(name, 0) + p
            term = (rest, tuple(sorted((n, p) for n, p in powers.items() if p)))
            out[term] = out.get(term, 0) + c * d * root
    return {t: c for t, c in out.items() if c}


class _Reader:
    """Reads an expression by recursive descent; every value is a pair of polynomials."""

    def __init__(self, text: str):
        self.tokens = re.findall(r"\d+\.\d*|\.\d+|\d+|[a-z]+|\*\*|[-+*/^()]|.", text, re.S)
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def all(self):
        value = self.sum()
        if self.peek():
            raise ValueError(f"unread: {self.peek()}")
        return value

    def sum(self):
        n, d = self.product()
        while self.peek() in ("+", "-"):
            sign = 1 if self.take() == "+" else -1
            m, e = self.product()
            n, d = _plus(_times(n, e), _times(m, d), sign), _times(d, e)
        return n, d

    def product(self):
        n, d = self.signed()
        while self.peek() in ("*", "/") or re.match(r"[\da-z.(]", self.peek()):
            divide = self.take() == "/" if self.peek() in ("*", "/") else False
            m, e = self.signed()
            if divide:
                if not m:
                    raise ZeroDivisionError
                m, e = e, m
            n, d = _times(n, m), _times(d, e)
        return n, d

    def signed(self):
        if self.peek() in ("+", "-"):
            negative = self.take() == "-"
            n, d = self.signed()
            return (_times(n, {_ONE: Fraction(-1)}) if negative else n), d
        return self.power()

    def power(self):
        n, d = self.atom()
        if self.peek() not in ("^", "**"):
            return n, d
        self.take()
        top, bottom = self.signed()
        if set(top) - {_ONE} or set(bottom) - {_ONE}:
            raise ValueError("a power that is no number")
        p = top.get(_ONE, Fraction(0)) / bottom[_ONE]
        if p.denominator == 2:
            (n, d), p = _root(n, d), p * 2
        if p.denominator != 1 or abs(p) > 64:
            raise ValueError("a power that is not whole")
        if p < 0:
            n, d, p = d, n, -p
        out = ({_ONE: Fraction(1)}, {_ONE: Fraction(1)})
        for _ in range(int(p)):
            out = _times(out[0], n), _times(out[1], d)
        return out

    def atom(self):
        token = self.take()
        if token == "(":
            value = self.sum()
            if self.take() != ")":
                raise ValueError("no closing bracket")
            return value
        if token[0].isdigit() or token[0] == "." and len(token) > 1:
            number = Fraction(token.rstrip(".") if token.endswith(".") else token)
            return ({_ONE: number} if number else {}), {_ONE: Fraction(1)}
        if not token.isalpha():
            raise ValueError(f"unexpected {token}")
        if self.peek() == "(" and token in ("sqrt", "sin", "cos", "tan", "log", "ln", "exp"):
            value = self.atom()
            return _root(*value) if token == "sqrt" else ({(1, ((f"{token}{sorted(value[0].items())}{sorted(value[1].items())}", 1),)): Fraction(1)}, {_ONE: Fraction(1)})
        return {(1, ((token, 1),)): Fraction(1)}, {_ONE: Fraction(1)}


def _root(n: dict, d: dict):
    """The square root of a positive rational number; of anything else a name of its own."""
    if not n:
        return n, d
    if set(n) == {_ONE} and set(d) == {_ONE} and n[_ONE] / d[_ONE] > 0:
        x = n[_ONE] / d[_ONE]
        square, rest = _free_of_squares(x.numerator * x.denominator)
        return {(rest, ()): Fraction(square, x.denominator)}, {_ONE: Fraction(1)}
    return {(1, ((f"root{sorted(n.items())}{sorted(d.items())}", 1),)): Fraction(1)}, {_ONE: Fraction(1)}


def same_expression(a: str, b: str) -> bool:
    """Equal values; what holds more than two letters, or powers that are not single digits, is not evaluated."""
    both = f"({a})-({b})"
    letters = {c for c in both.replace("sqrt", "").replace("frac", "") if c.isalpha()}
    if len(letters) > 2 or "^{" in both or "^(" in both or re.search(r"\^[0-9]+\^|\^[0-9][0-9]+", both):
        return False
    try:
        (n, d), (m, e) = _Reader(a).all(), _Reader(b).all()
        return bool(d) and bool(e) and _times(n, e) == _times(m, d)
    except (ValueError, IndexError, ZeroDivisionError, RecursionError):
        return False


def _elements(text: str) -> list[str]:
    text = _no_commas(text)
    if not text:
        return []
    if len(text) > 2 and text[0] in "()[]" and text[-1] in "()[]" and not re.search(r"[()\[\]]", text[1:-1]):
        return [x.strip() for x in text[1:-1].split(",")]
    return [text]


def same_formula(given: str | None, truth: str | None) -> bool:
    """Equal in literal form, or element by element in value. Two fractions must be the same text, and a whole number needs a whole number."""
    if given is None or truth is None:
        return False
    if literal_form(given) == literal_form(truth):
        return True
    a, b = evaluated_form(given), evaluated_form(truth)
    if a == b:
        return True
    x, y = _elements(a), _elements(b)
    if not a or len(x) != len(y) or len(y) > 1 and (a[0] != b[0] or a[-1] != b[-1]):
        return False
    fraction = re.compile(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")
    for p, q in zip(x, y, strict=True):
        if fraction.search(p) and fraction.search(q):
            same = p == q
        elif (_whole(p) is None) != (_whole(q) is None):
            same = False
        else:
            same = same_expression(q, p)
        if not same:
            return False
    return True


def final_form(answer: str) -> str:
    """The form in which whole-number answers are compared."""
    text = _replaced(answer.split("=")[-1], _FINAL)
    text = _replaced(text, [(x, "") for x in _FINAL_DROPPED])
    text = re.sub(r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$", text)
    text = re.sub(r"\\(?:text|textbf|overline)\{(.*?)\}", r"\1", text)
    text = re.sub(r"\\boxed\{(.*)\}", r"\1", text)
    text = re.sub(r"sqrt([^{])", r"sqrt{\1}", re.sub(r"frac([^{])(.)", r"frac{\1}{\2}", text)).replace("$", "")
    return (text.replace(",", "") if text.replace(",", "").isdigit() else text).strip()
