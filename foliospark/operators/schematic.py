"""Circuit diagrams read from text: subtype, page kind, components, nets, power rails, and filters over them.

All are Column expressions, so a page's nested arrays are made and searched in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: References of parts, rails with a voltage, net labels, package sizes.
PART = r"\b([CRUQLDBVFMJXT]\d+[A-Z]?)\b"
RAIL = r"\b((?:VDDA|VDD|VCC)_[A-Z0-9_]+)\s+(\d+(?:\.\d+)?V)"
NET = r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"
LABEL = r"(?:^|\s)(VCC|VDD|VSS|GND|AVDD|DVDD|RVDD|MVDD|3V3|1V8|5V)(?:_|\s|$)"


#: File names and titles of circuit diagrams, references that count, and how many of them with a label do.
NAMED, TITLED, DENSE_PART, DENSE = r"_sch\.|_schematic\.|\.sch\.|schematic\.", "schematic|circuit|sch", r"\b[RCUQLDBVFM]\d{3,}\b", 10


def subtype(filename: Column, title: Column, text: Column) -> Column:
    """schematic by name, title or content (ten parts and a net label at least), else null (X-08)."""
    content = (F.regexp_count(text, F.lit(DENSE_PART)) >= DENSE) & text.rlike(LABEL)
    return F.when(F.lower(filename).rlike(NAMED) | F.coalesce(F.lower(title).rlike(TITLED), F.lit(False)) | content, "schematic")


#: What makes a page of a kind, the first that fits: (kind, of the title or text, patterns that all must be there).
KINDS = (
    ("power_layout", "title", ("power", "gnd")),
    ("power_tree", "text", ("power tree|power on sequence",)),
    ("power_desc", "text", ("power description|work voltage",)),
    ("power_layout", "text", ("caps should be placed|placed under",)),
    ("pinmux", "text", ("pin", "mux|function|gpio|pwm|uart|i2c", "(?s)(?-i:(PWM.*){4}|(UART.*){4}|(GPIO.*){6})")),
    ("dcdc", "text", ("dcdc",)),
    ("dcdc", "text", ("buck", "w≥")),
)
#: Kinds of parts by the first letter of their reference.
PARTS = {"C": "capacitor", "R": "resistor", "U": "chip", "Q": "transistor", "L": "inductor", "D": "diode", "J": "connector", "X": "crystal"}


def page_kind(text: Column, title: Column) -> Column:
    """The kind of the first rule of KINDS that fits, or unknown (X-05)."""
    columns = {"text": text, "title": F.coalesce(title, F.lit(""))}
    kind = F.lit("unknown")
    for name, column, patterns in reversed(KINDS):
        fits = F.lit(True)
        for pattern in patterns:
            fits = fits & columns[column].rlike(f"(?i){pattern}")
        kind = F.when(fits, name).otherwise(kind)
    return kind


def components(text: Column) -> Column:
    """array(struct(ref, kind)): each part once, in order (X-05)."""
    kinds = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(PART), 1))
    return F.transform(refs, lambda r: F.struct(r.alias("ref"), F.coalesce(F.try_element_at(kinds, F.substring(r, 1, 1)), F.lit("other")).alias("kind")))


def nets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NET), 1))


def power(text: Column) -> Column:
    """array(struct(name, voltage)): the first voltage of each rail (X-05)."""
    names, volts = F.regexp_extract_all(text, F.lit(RAIL), 1), F.regexp_extract_all(text, F.lit(RAIL), 2)
    pairs = F.arrays_zip(names.alias("name"), volts.alias("voltage"))
    return F.filter(pairs, lambda p, i: F.array_position(names, p["name"]) == i + 1)


def find(items: Column, field: str, word: Column) -> Column:
    """Those of an array of structs whose field contains a word, case apart (X-07)."""
    return F.filter(items, lambda x: F.contains(F.lower(x[field]), F.lower(word)))


def searchable(text: Column) -> Column:
    """Parts, nets and rails of a page as one line to be searched (X-07, K-17)."""
    rails = F.transform(power(text), lambda p: F.concat_ws(" ", p["name"], p["voltage"]))
    return F.concat_ws(" | ", F.array_join(F.transform(components(text), lambda c: c["ref"]), " "), F.array_join(nets(text), " "), F.array_join(rails, ", "))


SUPPLY = "array<struct<name:string,voltage:string,source:string,max_current:string>>"
PINS = "array<struct<pin:string,ball:string,functions:array<string>,default_function:string>>"


def _listed(answer: Column, kind: str) -> Column:
    """The JSON list of an answer, fenced or among words, if a list is what it begins with; else null."""
    first = F.regexp_extract(answer, r"([\[{])", 1)
    return F.when(first == "[", F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), kind))


def model_power(answer: Column, text: Column) -> Column:
    """array(struct(name, voltage, source, max_current)) from a model's list or object of supplies, else by the rule for rails (X-06)."""
    inside = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), f"power_supplies {SUPPLY}")["power_supplies"]
    none = F.lit(None).cast("string")
    by_rule = F.transform(power(text), lambda p: F.struct(p["name"].alias("name"), p["voltage"].alias("voltage"), none.alias("source"), none.alias("max_current")))
    return F.coalesce(_listed(answer, SUPPLY), inside, by_rule)


def model_pins(answer: Column) -> Column:
    """array(struct(pin, ball, functions, default_function)) from a model's list; empty without one (X-06)."""
    return F.coalesce(_listed(answer, PINS), F.array().cast(PINS))
