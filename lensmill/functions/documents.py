"""Driving licences, identity cards and the extraction row, as native columns over text and array<struct> lines.

Lines are array<struct<text,confidence,x,y,width,height>> in reading order; text is their join by line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lensmill.functions.mrz import squeezed, trimmed, with_mrz

# Patterns, substitution pairs and word lists.
LICENCE_NUMBER = "(?<![A-Z0-9_])([A-Z0-9]{13}[0-9][A-Z0-9]{2})(?: ?[0-9]{0,2})?(?![A-Z0-9_])"
LETTER_SLOTS = (1, 2, 3, 4, 5, 12, 13, 15, 16)
SLOT_LETTERS, SLOT_DIGITS = "OQILZSBG", "00112586"
SLOT_FIGURES, SLOT_NAMES = "015862", "OISBGZ"
LICENCE_DATE = "(?<![A-Za-z0-9_])([0-9]{2})[./-]([0-9]{2})[./-]([0-9]{4})(?![A-Za-z0-9_])"
CARD_DATE = "(?<![A-Za-z0-9_])([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})(?![A-Za-z0-9_])"
CATEGORIES = "(?<![A-Z0-9_])(?:A1|A2|AM|B1|BE|C1E|C1|CE|D1E|D1|DE|[ABCDEFGHKMNPQ])(?![A-Za-z0-9_])(?=[^A-Z])"
LICENCE_STOP, CARD_STOP = "DRIVING|LICEN[CS]E|UNITED|KINGDOM", "IDENTITY|CARD|NATIONAL|REPUBLIC|GOVERNMENT"
LICENCE_NAME, CARD_NAME = "^[A-Z][A-Z\\s'-]+$", "^[A-Z][A-Z\\s'-]{2,40}$"
LABELLED = "(?:^|\\n)\\s*{n}[\\s.)\\-:]*([A-Z][A-Z\\s'-]{{1,40}})"
COUNTRY = "United Kingdom"


def number_at(s: Column) -> Column:
    """Leading whole number of a text, as parseInt reads it; null if there is none."""
    return F.nullif(F.regexp_extract(s, "^\\s*([0-9]+)", 1), F.lit("")).try_cast("int")


def licence_number(upper: Column) -> Column:
    raw = F.regexp_extract(F.regexp_replace(upper, "(?U)\\s+", " "), LICENCE_NUMBER, 1)
    slots = []
    for i in range(1, 17):
        c = F.substring(raw, i, 1)
        slots.append(F.translate(c, SLOT_FIGURES, SLOT_NAMES) if i in LETTER_SLOTS else F.translate(c, SLOT_LETTERS, SLOT_DIGITS))
    return F.concat(*slots)


def dates(upper: Column, pattern: str) -> Column:
    """All dates in the text as ISO texts, sorted."""
    parts = F.arrays_zip(*[F.regexp_extract_all(upper, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "d"), (2, "m"), (3, "y"))])
    fits = F.filter(parts, lambda x: x["m"].cast("int").between(1, 12) & x["d"].cast("int").between(1, 31))
    return F.sort_array(F.transform(fits, lambda x: F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0"))))


def nth(array: Column, i: int) -> Column:
    return F.coalesce(F.get(array, i), F.lit(""))


def last(array: Column) -> Column:
    return F.coalesce(F.try_element_at(array, F.lit(-1)), F.lit(""))


def clean_field(s: Column) -> Column:
    return squeezed(F.regexp_replace(s, "^[0-9.)\\s:]+", ""))


def joined(parts: list[Column], by: str = " ") -> Column:
    """The parts that are not empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), by)


def first_index(lines: Column, wanted) -> Column:
    """Place (from 1) of the first line that is wanted, 0 if none is."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: F.coalesce(wanted(x), F.lit(False))), F.lit(True)), F.lit(0)).cast("int")


def line_after(lines: Column, wanted) -> Column:
    at = first_index(lines, wanted)
    return F.when(at > 0, F.coalesce(F.get(lines, at)["text"], F.lit(""))).otherwise("")


def lines_from(lines: Column, wanted, count: int, clean) -> Column:
    at = first_index(lines, wanted)
    own = F.transform(F.slice(lines, F.greatest(at, F.lit(1)), count), lambda x: clean(x["text"]))
    return F.when(at > 0, F.array_join(F.filter(own, lambda x: x != ""), ", ")).otherwise("")


def name_candidates(lines: Column, pattern: str, stop: str, order, trim=lambda x: trimmed(x["text"])) -> Column:
    """Texts of upper lines that look like names, sorted by order(line), earlier lines first on ties."""
    numbered = lambda own: F.transform(own, lambda x, i: F.struct(order(x).alias("k"), i.alias("i"), x["text"].alias("t")))
    fits = lambda x: (x["y"] < 0.55) & (F.length(x["text"]) >= 2) & trim(x).rlike(pattern) & ~F.upper(x["text"]).rlike(stop)
    return F.transform(F.sort_array(numbered(F.filter(lines, fits))), lambda x: x["t"])


def with_licence(df, text: str = "text", lines: str = "lines", as_of_year: int = 2026):
    """df with full_name, licence_number, date_of_birth, expiry_date, issue_date, address, categories, country, ok."""
    c = F.col
    rows = F.coalesce(c(lines), F.array().cast("array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>"))
    # Every search below looks at the trimmed texts.
    rows = F.transform(rows, lambda x: F.struct(x["text"].alias("text"), x["y"].alias("y"), trimmed(x["text"]).alias("trim")))
    out = df.withColumns({"_u": F.upper(F.coalesce(c(text), F.lit(""))), "_l": rows})
    out = out.withColumns({"licence_number": licence_number(c("_u")), "_d": dates(c("_u"), LICENCE_DATE)})
    yy, mm, dd = (F.substring(c("licence_number"), a, 2) for a in (6, 8, 10))
    born = nth(c("_d"), 0)
    year, month = number_at(yy), number_at(mm)
    recon = F.coalesce((F.when(year > as_of_year % 100, 1900).otherwise(2000) + year).cast("string"), F.lit("NaN"))
    corrected = F.when(month > 50, F.lpad((month - 50).cast("string"), 2, "0")).otherwise(mm)
    check = (c("licence_number") != "") & (born != "") & (yy != F.substring(born, 3, 2)) & F.substring(born, 1, 4).cast("int").between(1900, as_of_year)
    check = check & F.coalesce(number_at(corrected).between(1, 12), F.lit(False))
    by_label = lambda n: line_after(c("_l"), lambda x: x["trim"].rlike(f"^{n}\\.?\\s*$"))
    labelled = lambda n: F.regexp_extract(c("_u"), LABELLED.format(n=n), 1)
    prefix = F.regexp_replace(F.substring(c("licence_number"), 1, 5), "9+$", "")
    out = out.withColumns(
        {
            "date_of_birth": F.when(F.size("_d") == 0, "").when(check, F.concat_ws("-", recon, corrected, dd)).otherwise(born),
            "issue_date": F.when(F.size("_d") >= 3, nth(c("_d"), 1)).otherwise(""),
            "expiry_date": F.when(F.size("_d") >= 2, last(c("_d"))).otherwise(""),
            "_s": F.coalesce(F.nullif(by_label(1), F.lit("")), F.nullif(labelled(1), F.lit("")), F.when(F.length(prefix) >= 3, prefix), F.lit("")),
            "_g": F.coalesce(F.nullif(by_label(2), F.lit("")), labelled(2)),
            "_c": name_candidates(c("_l"), LICENCE_NAME, LICENCE_STOP, lambda x: x["y"], lambda x: x["trim"]),
        }
    )
    surname = F.when(c("_s") == "", nth(c("_c"), 0)).otherwise(c("_s"))
    given = F.when(c("_g") == "", nth(c("_c"), 1)).otherwise(c("_g"))
    out = out.withColumns(
        {
            "full_name": joined([clean_field(given), clean_field(surname)]),
            "address": lines_from(c("_l"), lambda x: x["trim"].rlike("^8[.)\\s:]+"), 4, clean_field),
            "categories": F.slice(F.array_distinct(F.regexp_extract_all(c("_u"), F.lit(CATEGORIES), F.lit(0))), 1, 12),
            "country": F.lit(COUNTRY),
        }
    )
    return out.withColumn("ok", (c("licence_number") != "") | (c("full_name") != "")).drop("_u", "_l", "_d", "_s", "_g", "_c")


def with_id_card(df, text: str = "text", lines: str = "lines", as_of_year: int = 2026):
    """df with full_name, id_number, date_of_birth, expiry_date, address, nationality, ok; an identity zone comes first."""
    c = F.col
    keep = df.columns
    own = with_mrz(df.withColumn("_t", F.coalesce(c(text), F.lit(""))), "_t", as_of_year)
    zone = c("ok") & (c("kind") == "identity")
    lined = F.coalesce(c(lines), F.array().cast("array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>"))
    upper = F.upper(c("_t"))
    told = F.get(F.filter(F.split(upper, "\n", -1), lambda x: x.rlike("ID|NUMBER|NO[.:]")), F.lit(0))
    number = F.regexp_extract(F.coalesce(told, upper), "(?<![A-Z0-9_])[A-Z0-9]{6,15}(?![A-Z0-9_])", 0)
    own = own.withColumn("_d", dates(upper, CARD_DATE))
    name = nth(name_candidates(lined, CARD_NAME, CARD_STOP, lambda x: -F.length(x["text"])), 0)
    address = lines_from(lined, lambda x: F.upper(x["text"]).rlike("ADDRESS"), 3, trimmed)
    out = own.select(
        *keep,
        F.when(zone, joined([c("first_name"), c("last_name")])).otherwise(trimmed(name)).alias("full_name"),
        F.when(zone, c("document_number")).otherwise(number).alias("id_number"),
        F.when(zone, c("date_of_birth")).otherwise(nth(c("_d"), 0)).alias("_born"),
        F.when(zone, c("expiry_date")).when(F.size("_d") > 1, last(c("_d"))).otherwise("").alias("_ends"),
        F.when(zone, "").otherwise(address).alias("address"),
        F.when(zone, c("nationality")).otherwise("").alias("_from"),
        zone.alias("_zone"), c("ok").alias("_mrz_ok"), c("valid_checks").alias("_checks"), c("mrz_raw").alias("_raw"),
    )
    out = out.withColumnsRenamed({"_born": "date_of_birth", "_ends": "expiry_date", "_from": "nationality"})
    return out.withColumn("ok", c("_zone") | (c("id_number") != "") | (c("full_name") != "")).drop("_zone")


def extract(captures, as_of_year: int = 2026):
    """One row a capture (capture_id, document_type, text, lines, confidence): the structured document.

    Each type is parsed by its own branch, so no row pays for another type's parser.
    """
    c = F.col
    blank = trimmed(F.coalesce(c("text"), F.lit(""))) == ""
    base = captures.select("capture_id", "document_type", "text", "lines", F.when(blank, 0.0).otherwise(c("confidence")).alias("confidence"), blank.alias("blank"))

    def shaped(df, success, name, number, dob, expiry, nationality, address, mrz, valid):
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select("capture_id", success.alias("success"), valid.cast("boolean").alias("mrz_valid"), "document_type", text(name).alias("name"), text(number).alias("document_number"), text(dob).alias("dob"), text(expiry).alias("expiry"), text(nationality).alias("nationality"), text(address).alias("address"), text(mrz).alias("mrz"), "confidence")

    kind = lambda *types: base.where(~c("blank") & c("document_type").isin(*types))
    zone = with_mrz(kind("PASSPORT", "VISA"), "text", as_of_year)
    visa = c("kind") == "visa"
    valid = F.when(c("ok"), c("valid_checks") == 3)
    passports = shaped(zone, c("ok"), joined([c("first_name"), c("last_name")]), F.when(visa, c("visa_number")).otherwise(c("document_number")), c("date_of_birth"), F.when(visa, c("visa_expiry_date")).otherwise(c("expiry_date")), c("nationality"), "", c("mrz_raw"), valid)
    own = with_licence(kind("DRIVING_LICENCE"), as_of_year=as_of_year)
    licences = shaped(own, c("ok"), c("full_name"), c("licence_number"), c("date_of_birth"), c("expiry_date"), c("country"), c("address"), "", F.lit(None))
    own = with_id_card(kind("ID_CARD", "RESIDENCE_PERMIT"), as_of_year=as_of_year)
    cards = shaped(own, c("ok"), c("full_name"), c("id_number"), c("date_of_birth"), c("expiry_date"), c("nationality"), c("address"), F.when(c("_mrz_ok"), c("_raw")).otherwise(""), F.when(c("_mrz_ok"), c("_checks") == 3))
    known = ("PASSPORT", "VISA", "DRIVING_LICENCE", "ID_CARD", "RESIDENCE_PERMIT")
    rest = base.where(c("blank") | c("document_type").isNull() | ~c("document_type").isin(*known))
    return passports.unionByName(licences).unionByName(cards).unionByName(shaped(rest, F.lit(False), "", "", "", "", "", "", "", F.lit(None)))
