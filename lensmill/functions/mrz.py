"""Machine-readable zones: check digits, OCR repair, dates, names, block search and field extraction, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lensmill.functions.geometry import bound

# Substitution pairs and the check digit's alphabet and weights.
LETTERS, THEIR_DIGITS = "OQDILTZEASGB", "000111234568"
DIGITS, THEIR_LETTERS = "012568", "OIZSGB"
ALPHABET, WEIGHTS = "123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (7, 3, 1)
#: All that (?U)\\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
OPENERS = "«»{[(}])"
#: format: (lines, shortest, longest, width, first characters, needs '<<'); in order of precedence.
FORMATS = {
    "TD3": (2, 40, 48, 44, "PFR", True),
    "MRV_A": (2, 40, 48, 44, "V", True),
    "TD1": (3, 28, 32, 30, "IAC", False),
    "MRV_B": (2, 33, 39, 36, "V", True),
}
FIELDS = ("first_name", "last_name", "document_number", "nationality", "date_of_birth", "gender", "expiry_date", "issuing_authority", "mrz_raw", "visa_number", "visa_expiry_date", "identity_format")


def to_digits(s: Column) -> Column:
    return F.translate(s, LETTERS, THEIR_DIGITS)


def to_letters(s: Column) -> Column:
    return F.translate(s, DIGITS, THEIR_LETTERS)


def check_digit(s: Column, length: int) -> Column:
    """Weighted sum modulo 10, unrolled over the fixed length; a place in ALPHABET is the value, all else counts 0."""
    padded = F.rpad(s, length, "<")
    total = F.lit(0)
    for i in range(length):
        total = total + F.instr(F.lit(ALPHABET), F.substring(padded, i + 1, 1)) * WEIGHTS[i % 3]
    return total % 10


def reconcile(raw: Column, check: Column, length: int) -> Column:
    """struct<value, ok>: the text itself if its check digit fits, else its repaired form, whether that fits or not."""

    def choice(x: Column) -> Column:
        fits = lambda s: check_digit(s, length).cast("string") == x["wanted"]
        return F.when(fits(x["raw"]), F.struct(x["raw"].alias("value"), F.lit(True).alias("ok"))).otherwise(F.struct(x["fixed"].alias("value"), fits(x["fixed"]).alias("ok")))

    return bound(F.struct(raw.alias("raw"), to_digits(raw).alias("fixed"), to_digits(check).alias("wanted")), choice)


def trimmed(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


def squeezed(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, "(?U)\\s+", " "))


def clean_name(s: Column) -> Column:
    return squeezed(F.translate(to_letters(s), "<", " "))


def strip_fillers(s: Column) -> Column:
    return trimmed(F.translate(F.regexp_replace(s, "<+$", ""), "<", " "))


def mrz_date(s: Column, birth: bool, as_of_year: int) -> Column:
    """YYMMDD as an ISO date, '' if it is none. Births pivot on the year, expiries are always 20YY."""
    yy, mm, dd = (F.substring(s, i, 2) for i in (1, 3, 5))
    number = lambda x: x.try_cast("int")
    century = F.when(number(yy) <= as_of_year % 100, "20").otherwise("19") if birth else F.lit("20")
    ok = s.rlike("^[0-9]{6}$") & number(mm).between(1, 12) & number(dd).between(1, 31)
    return F.when(ok, F.concat(century, yy, F.lit("-"), mm, F.lit("-"), dd)).otherwise("")


def gender(s: Column) -> Column:
    return F.when(s == "M", "Male").when(s == "F", "Female").otherwise("")


def normal_line(s: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(s), "(?U)\\s+", ""), OPENERS, "<" * len(OPENERS))


def fixed_width(s: Column, width: int) -> Column:
    return F.rpad(s, width, "<")


def normal_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r?\n", -1), normal_line), lambda x: F.length(x) > 0)


def block(lines: Column) -> Column:
    """struct<format, l1, l2, l3> of the first block of normal_lines() by precedence of format, then place; null if there is none.

    lines should be a column that is there, as every place looks at it. Texts with no line of a format's length are not searched.
    """
    shortest, longest = min(f[1] for f in FORMATS.values()), max(f[2] for f in FORMATS.values())

    def candidates(every: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(every)), lambda i: F.length(F.element_at(every, i)).between(shortest, longest))

        def at(i: Column) -> Column:
            return bound(F.struct(*[F.try_element_at(every, i + k).alias(f"l{k}") for k in range(3)]), lambda o: of([o[f"l{k}"] for k in range(3)], i))

        def of(own: list[Column], i: Column) -> Column:
            found = None
            for place, (name, (n, lo, hi, width, first, filler)) in enumerate(FORMATS.items()):
                fits = F.substring(own[0], 1, 1).isin(*first)
                if filler:
                    fits = fits & own[0].contains("<<")
                for x in own[:n]:
                    fits = fits & F.coalesce(F.length(x).between(lo, hi), F.lit(False))
                padded = [fixed_width(x, width) if k < n else F.lit(None).cast("string") for k, x in enumerate(own)]
                # TD3 and MRV_A are searched together, line by line.
                value = F.struct(F.lit(max(0, place - 1)).alias("rank"), i.alias("at"), F.lit(name).alias("format"), padded[0].alias("l1"), padded[1].alias("l2"), padded[2].alias("l3"))
                found = F.when(fits, value) if found is None else found.when(fits, value)
            return found

        return F.array_min(F.filter(F.transform(places, at), lambda x: x.isNotNull()))

    return F.when(F.exists(lines, lambda x: F.length(x).between(shortest, longest)), candidates(lines))


def names(field: Column) -> tuple[Column, Column]:
    """First and last name: what follows the first '<<', joined by spaces, and what stands before it."""
    parts = F.split(field, "<<", -1)
    return clean_name(F.array_join(F.slice(parts, 2, 1000), " ")), clean_name(F.element_at(parts, 1))


def with_mrz(df, text: str = "text", as_of_year: int = 2026):
    """df with ok, kind, format, valid_checks and the fields of FIELDS ('' where missing)."""
    c = F.col
    # Lines only get shorter once they are upper case, so a text without a line as long as the shortest zone's is not looked at.
    shortest = min(f[1] for f in FORMATS.values())
    long = F.exists(F.split(F.upper(c(text)), "\n", -1), lambda x: F.length(x) >= shortest)
    out = df.withColumn("_n", F.when(long, normal_lines(c(text)))).withColumn("_b", block(c("_n"))).drop("_n")
    td1 = c("_b.format") == "TD1"
    cut = lambda line, a, b: F.substring(c(f"_b.{line}"), a + 1, b - a)
    pick = lambda one, other: F.when(td1, one).otherwise(other)
    found = lambda x: F.when(c("_b").isNotNull(), x)
    out = out.withColumns(
        {
            "_doc": found(reconcile(pick(cut("l1", 5, 14), cut("l2", 0, 9)), pick(cut("l1", 14, 15), cut("l2", 9, 10)), 9)),
            "_dob": found(reconcile(pick(cut("l2", 0, 6), cut("l2", 13, 19)), pick(cut("l2", 6, 7), cut("l2", 19, 20)), 6)),
            "_exp": found(reconcile(pick(cut("l2", 8, 14), cut("l2", 21, 27)), pick(cut("l2", 14, 15), cut("l2", 27, 28)), 6)),
            "_names": pick(c("_b.l3"), F.substring(c("_b.l1"), 6, 100)),
        }
    )
    first, last = names(c("_names"))
    number, expiry = strip_fillers(c("_doc.value")), mrz_date(c("_exp.value"), False, as_of_year)
    visa = F.coalesce(c("_b.format").startswith("MRV"), F.lit(False))
    missing = c("_b").isNull()
    values = {
        "first_name": first,
        "last_name": last,
        "document_number": F.when(visa, "").otherwise(number),
        "nationality": to_letters(strip_fillers(pick(cut("l2", 15, 18), cut("l2", 10, 13)))),
        "date_of_birth": mrz_date(c("_dob.value"), True, as_of_year),
        "gender": gender(pick(cut("l2", 7, 8), cut("l2", 20, 21))),
        "expiry_date": F.when(visa, "").otherwise(expiry),
        "issuing_authority": to_letters(strip_fillers(cut("l1", 2, 5))),
        "mrz_raw": F.concat_ws("\n", "_b.l1", "_b.l2", "_b.l3"),
        "visa_number": F.when(visa, number).otherwise(""),
        "visa_expiry_date": F.when(visa, expiry).otherwise(""),
        "identity_format": F.when(visa, "").otherwise(c("_b.format")),
    }
    checks = sum((c(f"{x}.ok").cast("int") for x in ("_doc", "_dob", "_exp")), F.lit(0))
    out = out.withColumns({k: F.when(missing, "").otherwise(F.coalesce(v, F.lit(""))) for k, v in values.items()} | {"format": c("_b.format"), "kind": F.when(visa, "visa").otherwise("identity"), "valid_checks": F.coalesce(checks, F.lit(0))})
    some = F.concat("document_number", "visa_number", "expiry_date", "visa_expiry_date", "first_name", "last_name", F.when(visa, "").otherwise(c("date_of_birth"))) != ""
    return out.withColumn("ok", ~missing & some).drop("_b", "_doc", "_dob", "_exp", "_names")
