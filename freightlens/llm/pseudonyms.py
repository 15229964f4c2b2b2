"""Format-preserving pseudonyms of personal data, by keyed Feistel permutations.

Only DataFrame functions.  Personal values are found by one pattern, validated by
kind, and replaced by the image of a permutation of the kind's own format:

* card numbers (13 to 19 digits, correct check digit): all digits but the last are
  permuted, the check digit is set anew;
* IPv4 addresses (parts up to 255), social security numbers (valid area, group,
  serial) and ISO dates (existing days): their number among all valid values is
  permuted, so the image is valid;
* IPv6 addresses (eight groups, or fewer around one ``::``, with a digit at least): their
  128 bits are permuted, so all spellings of an address share a pseudonym, which is
  written in eight groups;
* phone numbers and e-mail names: letters stay letters and digits digits, in place;
  domains stay.

A number below a * b is split as (n div b, n mod b); rounds add a keyed hash of one
part to the other, modulo its own size.  This is a bijection on exactly the valid
values, so equal values get equal pseudonyms in all documents and different values
different ones; ``reveal`` runs the rounds backwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .joins import free_name

ROUNDS = 8

#: Fixed patterns of the kinds, tried in this order at each place.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){3}(?![\d-])|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]|\.\d)",
    # by customary groups first, so that numbers beside a card don't join it
    "card": r"(?<![\d-])\d{4}(?:[ -]\d{4}){3}(?![\d-])|(?<![\d-])\d{4}[ -]\d{6}[ -]\d{5}(?![\d-])|(?<![\d-])\d{13,19}(?![\d-])"
    r"|(?<![\d-])\d{4}(?:[ -]\d{3,6}){2,4}(?![\d-])",
}
PATTERN = "|".join(KINDS.values())


def keyed(key: str, tag: Column, value: Column) -> Column:
    """A keyed 52-bit hash of a value; ``tag`` names kind and round."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, value.cast("string")), 256), 1, 13), 16, 10).cast("long")


def permuted(n: Column, a: int, b: int, key: str, kind: str, back: bool = False) -> Column:
    """The image of n under a keyed permutation of [0, a * b), or its origin."""
    start = F.struct(F.floor(n / b).cast("long").alias("l"), (n % b).cast("long").alias("r"))
    order = range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1)

    def step(s, i):
        odd = i % 2 == 1
        sign = -1 if back else 1
        tag = F.concat_ws(":", F.lit(kind), i.cast("string"))
        left = F.when(odd, F.pmod(s["l"] + sign * keyed(key, tag, s["r"]), F.lit(a))).otherwise(s["l"])
        right = F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + sign * keyed(key, tag, s["l"]), F.lit(b)))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda s: s["l"] * b + s["r"])


def permuted_bits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """The image of 32 hexadecimal digits under a keyed permutation of 128 bits."""
    bits = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
    order = range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1)

    def step(s, i):
        tag, odd = F.concat_ws(":", F.lit(kind), i.cast("string")), i % 2 == 1
        mask = lambda x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, x.cast("string")), 256), 1, 16), 16, -10).cast("long")
        return F.struct(
            F.when(odd, s["l"].bitwiseXOR(mask(s["r"]))).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(s["r"].bitwiseXOR(mask(s["l"]))).alias("r"),
        )

    text = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    start = F.struct(bits(1).alias("l"), bits(17).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda s: F.concat(text(s["l"]), text(s["r"])))


def shifted(text: Column, other: Column, key: str, tag: Column, sign: int) -> Column:
    """Each letter or digit of ``text`` moved within its class by a keyed hash of ``other``; classes of ``text`` stay."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, other), 512)

    def move(c, i):
        step = F.conv(F.substring(F.concat(digest, F.sha2(digest, 512)), i * 3 % 240 + 1, 6), 16, 10).cast("int")
        code = F.ascii(c)
        turn = lambda base, size: F.chr((F.pmod(code - base + sign * step, F.lit(size)) + base).cast("long"))
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permuted_text(text: Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of all texts of the same classes by place: a Feistel network over the two halves."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    order = range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1)

    def step(s, i):
        tag, odd = F.concat_ws(":", F.lit(kind), i.cast("string")), i % 2 == 1
        sign = -1 if back else 1
        return F.struct(
            F.when(odd, shifted(s["l"], s["r"], key, tag, sign)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(shifted(s["r"], s["l"], key, tag, sign)).alias("r"),
        )

    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda s: F.concat(s["l"], s["r"]))


def check_sum(digits: Column, first: int) -> Column:
    """Sum of digits from the right, every second one doubled (less 9 above 9); ``first`` is 1 to double the rightmost."""
    d = F.reverse(F.split(digits, ""))
    each = F.transform(d, lambda c, i: F.when(i % 2 == 1 - first, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _pattern_of(value: Column, digits: Column) -> Column:
    """``digits`` set into the places of the digits of ``value``."""
    chars = F.split(value, "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    put = lambda s, c: F.when(
        c.between("0", "9"), F.struct(F.concat(s["s"], F.substr(digits, s["i"], F.lit(1))).alias("s"), (s["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i")))
    return F.aggregate(chars, start, put, lambda s: s["s"])


def _day(value: Column) -> Column:
    """The day a date names, as yyyy-mm-dd or mm/dd/yyyy."""
    return F.when(value.contains("/"), F.try_to_date(value, "MM/dd/yyyy")).otherwise(F.try_to_date(value, "yyyy-MM-dd"))


def _groups(value: Column, side: int) -> Column:
    """The groups of an IPv6 address before (1) or after (2) its ``::``."""
    text = F.coalesce(F.get(F.split(value, "::", -1), F.lit(side - 1)), F.lit(""))
    return F.filter(F.split(text, ":"), lambda x: x != "")


def _address(value: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits."""
    left, right = _groups(value, 1), _groups(value, 2)
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda x: F.lpad(F.lower(x), 4, "0")), "")


def kind_of(value: Column) -> Column:
    """The kind of a found value if it is valid, else null."""
    part = lambda sep, i: F.element_at(F.split(value, sep), i).cast("int")
    return (
        F.when(value.contains("@"), "email")
        # without a digit it may be a word of program text, such as a::b
        .when(
            value.contains(":"),
            F.when(value.rlike("[0-9]") & (F.size(_groups(value, 1)) + F.size(_groups(value, 2)) <= F.when(value.contains("::"), 7).otherwise(8)), "ipv6"),
        )
        # octets with leading zeros would share a pseudonym with those without
        .when(value.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), F.when((F.greatest(*[part(r"\.", i) for i in (1, 2, 3, 4)]) <= 255) & ~value.rlike(r"(^|\.)0\d"), "ip"))
        .when(value.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), F.when(_day(value).between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date")), "date"))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(part("-", 1).between(1, 899) & (part("-", 1) != 666) & (part("-", 2) > 0) & (part("-", 3) > 0), "ssn"))
        .when(value.rlike(r"^\+|\(|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(F.length(digits_of(value)).between(13, 19) & (check_sum(digits_of(value), 0) % 10 == 0), "card")
    )


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a value of a kind, or the value of a pseudonym."""
    part = lambda sep, i: F.element_at(F.split(value, sep), i).cast("long")
    ip = permuted(((part(r"\.", 1) * 256 + part(r"\.", 2)) * 256 + part(r"\.", 3)) * 256 + part(r"\.", 4), 1 << 16, 1 << 16, key, "ip", back)
    octet = lambda i: F.shiftright(ip, 8 * i).bitwiseAND(F.lit(255).cast("long"))
    day = permuted(F.date_diff(_day(value), F.lit("1800-01-01").cast("date")).cast("long"), 189, 773, key, "date", back)
    moved_day = F.date_add(F.lit("1800-01-01").cast("date"), day.cast("int"))
    area = part("-", 1) - 1 - F.when(part("-", 1) > 666, 1).otherwise(0)
    ssn = permuted((area * 99 + part("-", 2) - 1) * 9999 + part("-", 3) - 1, 898, 99 * 9999, key, "ssn", back)
    new_area = F.floor(ssn / (99 * 9999)) + 1
    new_area = new_area + F.when(new_area >= 666, 1).otherwise(0)
    body = F.substr(digits_of(value), F.lit(1), F.length(digits_of(value)) - 1)
    moved = permuted_text(body, key, "card", back)
    card = F.concat(moved, F.pmod(-check_sum(moved, 1), F.lit(10)).cast("string"))
    name = F.substring_index(value, "@", 1)
    code = F.regexp_extract(value, r"^\+\d{1,3}", 0)
    return (
        F.when(kind == "ipv6", F.regexp_replace(permuted_bits(_address(value), key, "ipv6", back), "(.{4})(?!$)", "$1:"))
        .when(kind == "ip", F.concat_ws(".", *[octet(i).cast("string") for i in (3, 2, 1, 0)]))
        .when(kind == "date", F.when(value.contains("/"), F.date_format(moved_day, "MM/dd/yyyy")).otherwise(F.date_format(moved_day, "yyyy-MM-dd")))
        .when(kind == "ssn", F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.floor(ssn / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((ssn % 9999 + 1).cast("string"), 4, "0")))
        .when(kind == "card", _pattern_of(value, card))
        .when(kind == "phone", F.concat(code, permuted_text(F.substr(value, F.length(code) + 1, F.length(value)), key, "phone", back)))
        .when(kind == "email", F.concat(permuted_text(name, key, "email", back), F.substr(value, F.length(name) + 1, F.length(value))))
    )


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (all columns) with ``text`` pseudonymised and ``pii``: kind, value and pseudonym of each finding in turn.

    Invalid look-alikes stay as they are.  Null texts stay null with no finding, empty
    ones empty.  Rows are treated one by one, so repeats, ties and other columns don't
    matter; a column named ``pii`` is replaced.  An empty table gives an empty one.
    """
    hits, kinds, done_ = (free_name([*docs.columns, "pii"], c) for c in ("pii_found", "pii_typed", "pii_done"))
    found = docs.withColumn(hits, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    item = lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value"))
    typed = found.withColumn(kinds, F.transform(F.coalesce(hits, F.array().cast("array<string>")), item))
    done = typed.withColumn(
        done_, F.transform(kinds, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), F.coalesce(pseudonym(x["value"], x["kind"], key), x["value"]).alias("pseudonym")))
    )
    pieces = F.arrays_zip(F.split("text", PATTERN, -1).alias("a"), F.col(done_).getField("pseudonym").alias("b"))
    new = F.array_join(F.transform(pieces, lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit("")))), "")
    return (
        done.withColumn("text", F.when(F.size(kinds) > 0, new).otherwise(F.col("text")))
        .withColumn("pii", F.filter(done_, lambda x: x["kind"].isNotNull()))
        .drop(hits, kinds, done_)
    )


def op3(spark, sf_dir: str, key: str = "shipment") -> DataFrame:
    """The documents with personal data: their findings by kind, pseudonyms and the new text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymised(docs, key).where(F.size("pii") > 0)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).alias(f"n_{kind}")
    return out.select("doc_id", F.size("pii").alias("n_found"), *[count(k) for k in KINDS], F.array_join(F.col("pii.pseudonym"), "|").alias("pseudonyms"), "text")
