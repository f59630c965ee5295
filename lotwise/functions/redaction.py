"""STR33: credentials and personal data in free text, by plain expressions whose work grows with the text's length.

A text is taken line by line. A line with a word of ``WHOLE_LINES`` goes as a whole. In other lines, what lies in a URL before
``@`` and after ``?`` or ``#`` goes; then all that follows a private name and ``=`` or ``:``; then what has the shape of a
secret. An expression runs only on lines that have the characters which it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GONE = "[REDACTED]"
# Words whose lines go; parts of names (without marks) whose values are private; whole names that are.
WHOLE_LINES = ["cookie", "authorization"]
PRIVATE_PARTS = [
    "authorization", "cookie", "password", "passwd", "passphrase", "secret", "token", "credential", "apikey", "accesskey", "privatekey", "encrypted",
    "session", "bearer", "header", "config", "email", "phone", "contact", "ipaddr", "clientip", "remoteip", "remoteaddr", "userip", "forwardedfor",
    "payload", "jobdata", "signature",
]
PRIVATE_NAMES = ["auth", "pwd", "pass", "pw", "dsn", "sig", "ip", "cert", "jwt"]
#: Shapes of secrets, what stands for them, and what a line with it has: a digit, or one of some texts (in lower case).
SHAPES = [
    (r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{4,}", "$1 [REDACTED]", ["bearer", "basic"]),
    (r"\beyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]*", GONE, ["eyj"]),
    (r"\b(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}", GONE, ["k-", "k_"]),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}", GONE, ["gh"]),
    (r"\bAKIA[0-9A-Z]{16}\b", GONE, ["akia"]),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", GONE, ["xox"]),
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]", ["@"]),
    (r"(?<![\w-])\+\d[\d\s().-]{6,}\d", "[PHONE]", ["+"]),
    (r"(?<![\w-])\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?![\w-])", "[PHONE]", ["digit"]),
    (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", "[IP]", ["digit"]),
    (r"(?i)\b[A-HJ-NPR-Z0-9]{17}\b", "[VIN]", ["digit"]),
]
#: Letters of scripts in which a name can look like another: such names count as private.
FAR = r"À-῿Ⰰ-￿"


def let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def private_name(name: Column) -> Column:
    """Whether a name's value is private: by a part of it or as a whole, percent-decoded up to three times; what does not decode is private."""
    whole = "|".join([*PRIVATE_PARTS, f"^(?:{'|'.join(PRIVATE_NAMES)})$"])
    of = lambda n: F.lower(F.regexp_replace(n, "[^A-Za-z0-9]", "")).rlike(whole) | n.rlike(f"[{FAR}%]")
    decoded = name
    for _ in range(3):
        decoded = let(decoded, lambda n: F.when(F.contains(n, F.lit("%")), F.try_url_decode(F.replace(n, F.lit("+"), F.lit("%2B")))).otherwise(n))
    return F.coalesce(let(name, lambda n: F.when(F.contains(n, F.lit("%")), let(decoded, of)).otherwise(of(n))), F.lit(True))


def _assigns(piece: Column) -> Column:
    """Whether a piece of a line that ends in ``=`` or ``:`` ends in a private name: one of its last two words, or both together."""

    def of(run: Column) -> Column:
        last, two = F.substring_index(run, " ", -1), F.substring_index(run, " ", -2)
        return private_name(last) | private_name(F.substring_index(two, " ", 1)) | private_name(F.replace(two, F.lit(" "), F.lit("")))

    head = F.rtrim(F.regexp_replace(piece, r"[=:]$", ""), F.lit(" \t\"'\\"))
    plain = F.regexp_replace(F.translate(head, "\t", " "), rf"\[[A-Za-z0-9_.-]{{0,20}}\]$|[^A-Za-z0-9_.%+{FAR} -]", "\n")
    run = F.trim(F.regexp_replace(F.substring_index(F.rtrim(plain, F.lit("\n ")), "\n", -1), " +", " "))
    return F.contains(piece, F.lit("\\u")) | let(run, lambda r: (r != "") & of(r))


def _cut_assignments(line: Column) -> Column:
    def of(pieces: Column) -> Column:
        private = F.transform(pieces, lambda p: p.rlike("[=:]$") & _assigns(p))
        return let(F.array_position(private, True), lambda at: F.when(at > 0, F.concat(F.array_join(F.slice(pieces, 1, at.cast("int")), ""), F.lit(GONE))).otherwise(line))

    return F.when(line.rlike("[=:]"), let(F.split(line, "(?<=[=:])"), of)).otherwise(line)


def _cut_urls(line: Column) -> Column:
    """Words with ``://``: without what stands before ``@`` and after ``?`` or ``#``."""

    def of(word: Column) -> Column:
        at = F.instr(word, "://") + 3
        rest = F.substr(word, at)
        return let(F.regexp_extract(rest, "^[^?#]*", 0), lambda place: F.concat(
            F.substr(word, F.lit(1), at - 1), F.when(F.contains(place, F.lit("@")), f"{GONE}@").otherwise(""), F.substring_index(place, "@", -1),
            F.substr(rest, F.length(place) + 1, F.lit(1)), F.when(F.length(rest) > F.length(place) + 1, GONE).otherwise(""),
        ))

    words = F.split(line, r"(?<=\s)|(?=\s)")
    return F.array_join(F.transform(words, lambda w: F.when(F.contains(w, F.lit("://")), of(w)).otherwise(w)), "")


def _cut_shape(pattern: str, to: str, needs: list[str]):
    """A function of a line that puts ``to`` for a shape, and looks for it only where the line has what it needs."""

    def of(line: Column) -> Column:
        if "digit" in needs:
            may = line.rlike("[0-9]")
        elif len(needs) == 1:
            may = F.contains(F.lower(line), F.lit(needs[0]))
        else:
            may = F.lower(line).rlike("|".join(needs))
        return F.when(may, F.regexp_replace(line, pattern, to)).otherwise(line)

    return of


#: What a text has if it has a shape: a character, or one of some words (in lower case).
_MARKS, _WORDS = "@+0-9", "|".join(sorted({n for _, _, some in SHAPES for n in some if len(n) > 1 and n != "digit"}))


def _may_have_shape(c: Column) -> Column:
    return c.rlike(f"[{_MARKS}]") | F.lower(c).rlike(_WORDS)


def _may_have(c: Column) -> Column:
    """Whether a text has any character or word without which no step changes anything."""
    return c.rlike(f"[=:{_MARKS}]") | F.lower(c).rlike("|".join([*WHOLE_LINES, _WORDS]))


def redact(c: Column) -> Column:
    """A text without credentials and personal data; null stays null."""
    whole = lambda x: F.lower(x).rlike("|".join(WHOLE_LINES))
    lines = F.transform(F.split(c, "\n"), lambda x: F.when(whole(x), GONE).when(F.contains(x, F.lit("://")), _cut_urls(x)).otherwise(x))
    lines = F.when(c.rlike("[=:]"), F.transform(lines, _cut_assignments)).otherwise(lines)

    def shaped(line: Column) -> Column:
        return F.get(reduce(lambda l, shape: F.transform(l, _cut_shape(*shape)), SHAPES, F.array(line)), F.lit(0))

    lines = F.transform(lines, lambda x: F.when(_may_have_shape(x), shaped(x)).otherwise(x))
    return F.when(_may_have(c), F.array_join(lines, "\n")).otherwise(c)
