"""Hierarchical classification codes: parse, format, match, filter documents by them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("section", "class", "subclass", "maingroup", "subgroup")


def _pattern(separator: str) -> str:
    if separator.isalnum():
        raise ValueError("a separator must not be a letter or digit")
    return rf"^([A-Ha-h])(?:([0-9]{{2}})(?:([A-Za-z])(?:([0-9]{{1,4}})?(?:{re.escape(separator)}([0-9]{{1,4}}))?)?)?)?"


def parse(code: Column, separator: str = "-", zero_pad: bool = False) -> Column:
    """A struct of the parts and ``valid``.

    Parsing stops at the first missing part; no section at all gives an empty record.
    Class 0 and main group 0 raise in strict reading, so they're invalid here; with ``zero_pad``
    zero groups are padding and count as missing.
    """
    bare = F.regexp_replace(code, " ", "")
    part = lambda i: F.nullif(F.regexp_extract(bare, _pattern(separator), i), F.lit(""))
    klass, main, sub = part(2).cast("int"), part(4).cast("int"), part(5).cast("int")
    if zero_pad:
        sub, main = F.when((main > 0) & (sub > 0), sub), F.when(main > 0, main)
    else:
        sub = F.when(main.isNotNull(), sub)
    valid = ~F.coalesce(klass == 0, F.lit(False)) & ~F.coalesce(main == 0, F.lit(False))
    return F.struct(
        F.upper(part(1)).alias("section"), klass.alias("class"), F.upper(part(3)).alias("subclass"),
        main.alias("maingroup"), sub.alias("subgroup"), (code.isNotNull() & valid).alias("valid"),
    )


def parts(code: Column, separator: str = "-", zero_pad: bool = False) -> Column:
    """The record of a valid code, else null."""
    p = parse(code, separator, zero_pad)
    return F.when(p["valid"], p)


def n_set(record: Column) -> Column:
    return sum((record[p].isNotNull().cast("int") for p in PARTS), F.lit(0))


def padded(record: Column, separator: str = "-") -> Column:
    """Section, two-digit class, subclass, four-digit main group, separator and six-digit sub group, as far as they go."""
    pad = lambda p, n: F.lpad(record[p].cast("string"), n, "0")
    return F.concat(
        F.coalesce(record["section"], F.lit("")), F.coalesce(pad("class", 2), F.lit("")), F.coalesce(record["subclass"], F.lit("")),
        F.coalesce(pad("maingroup", 4), F.lit("")), F.coalesce(F.concat(F.lit(separator), pad("subgroup", 6)), F.lit("")),
    )


def prefixes(record: Column, separator: str = "-") -> Column:
    """The distinct padded forms of a record from its section to its last set part."""
    forms = []
    for i in range(1, len(PARTS) + 1):
        kept = F.struct(*(record[p].alias(p) if p in PARTS[:i] else F.lit(None).cast("string").alias(p) for p in PARTS))
        forms.append(padded(kept, separator))
    return F.array_distinct(F.filter(F.array(*forms), lambda f: f != ""))


def find_separator(code: Column) -> Column:
    """The first character that is no letter or digit."""
    return F.regexp_extract(code, "[^a-zA-Z0-9]", 0)


@dataclass(frozen=True)
class Code:
    """A record to match against; unset parts match anything."""

    section: str | None = None
    klass: int | None = None
    subclass: str | None = None
    maingroup: int | None = None
    subgroup: int | None = None

    def __post_init__(self):
        if self.section is not None and not re.fullmatch("[A-Ha-h]", self.section):
            raise ValueError("a section is a letter from A to H")
        if self.subclass is not None and not re.fullmatch("[A-Za-z]", self.subclass):
            raise ValueError("a subclass is a letter")
        for value, low, high in ((self.klass, 1, 99), (self.maingroup, 1, 9999), (self.subgroup, 0, 9999)):
            if value is not None and not low <= value <= high:
                raise ValueError(f"{value} isn't from {low} to {high}")

    def values(self) -> tuple:
        return (self.section, self.klass, self.subclass, self.maingroup, self.subgroup)

    @property
    def empty(self) -> bool:
        return self.section is None

    def regex(self, separator: str = "-") -> str:
        """Numbers may have leading zeros; a partial code matches all below it."""
        out, whole = "", True
        for name, value in zip(PARTS, self.values(), strict=True):
            if value is None:
                whole = False
                break
            if name == "subgroup":
                out += re.escape(separator)
            out += f"0*{value}" if isinstance(value, int) else f"[{value.upper()}{value.lower()}]"
        return out + ("" if whole else ".*")


def class_match(codes: Column, code: Code, separator: str = "-") -> Column:
    """Whether any raw code matches the record's pattern in full."""
    return F.coalesce(F.exists(codes, lambda c: c.rlike(f"^(?:{code.regex(separator)})$")), F.lit(False))


def same_record(a: Column, b: Column, fields: Iterable[str] = PARTS) -> Column:
    """Whether two records agree in these parts; unset parts agree with unset ones, letters whatever their case."""
    upper = lambda r, p: F.upper(r[p].cast("string"))
    return reduce(lambda x, y: x & y, [upper(a, p).eqNullSafe(upper(b, p)) for p in fields])


def all_of(*tests: Column) -> Column:
    """Documents that pass every test; an undecided one doesn't pass."""
    return reduce(lambda x, y: x & y, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def sloppy(
    codes: Column, code: Code, separator: str = "-", single: bool = False, exact: bool = False, zero_pad: bool = False,
    fields: Iterable[str] | None = None,
) -> Column:
    """All codes (with ``single`` one) equal the record in its first set part; ``exact`` compares all set parts, ``fields`` those given.

    Malformed codes are skipped; at least one must match. With ``single`` any equal
    part is enough.
    """
    records = F.filter(F.transform(codes, lambda c: parts(c, separator, zero_pad)), lambda r: r.isNotNull())
    wanted = [(p, v.upper() if isinstance(v, str) else v) for p, v in zip(PARTS, code.values(), strict=True) if v is not None]
    same = lambda r, p, v: F.coalesce(r[p] == F.lit(v), F.lit(False))

    def joined(r: Column, chosen: list, every: bool) -> Column:
        out = F.lit(every)
        for p, v in chosen:
            out = (out & same(r, p, v)) if every else (out | same(r, p, v))
        return out

    if single:
        return F.coalesce(F.exists(records, lambda r: joined(r, wanted, False)), F.lit(False))
    if fields is not None and set(names := list(fields)) - set(PARTS):
        raise ValueError(f"fields are some of {PARTS}")
    chosen = [w for w in wanted if w[0] in names] if fields is not None else wanted if exact else wanted[:1]
    return F.coalesce((F.size(records) > 0) & F.forall(records, lambda r: joined(r, chosen, True)), F.lit(False))


def greedy(codes: Column, code: Code, separator: str = "-", single: bool = False) -> Column:
    """All raw codes (with ``single`` one) match the record's pattern."""
    test = lambda c: c.rlike(f"^(?:{code.regex(separator)})$")
    if single:
        return class_match(codes, code, separator)
    return F.coalesce((F.size(codes) > 0) & F.forall(codes, test), F.lit(False))


def sections(codes: Column, separator: str = "-") -> Column:
    found = F.transform(codes, lambda c: parts(c, separator)["section"])
    return F.array_distinct(F.filter(found, lambda s: s.isNotNull()))


def max_sections(codes: Column, n: int, separator: str = "-") -> Column:
    return F.size(sections(codes, separator)) <= n


def standard_restriction(codes: Column, code: Code, separator: str = "-") -> Column:
    return all_of(class_match(codes, code, separator), sloppy(codes, code, separator))


def sort_keys(record: str) -> list[Column]:
    """Order by section, class, subclass, main group, sub group; empty parts first."""
    return [F.asc_nulls_first(F.col(f"{record}.{p}")) for p in PARTS]
