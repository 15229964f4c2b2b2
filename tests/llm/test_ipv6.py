"""IPv6 addresses in texts, against the standard library's reading of them."""

import ipaddress
import random

from pyspark.sql import functions as F

from freightlens.llm import pseudonyms

from .test_operators import table


def rows_of(spark, texts):
    return {r.doc_id: r for r in pseudonyms.pseudonymised(table(spark, texts), "k").collect()}


def test_addresses_are_linked_valid_and_reversible(spark):
    rng = random.Random(4)
    addresses = [ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 16, 60, 127]) << rng.choice([0, 1]) & (1 << 128) - 1) for _ in range(60)]
    addresses += [ipaddress.IPv6Address(x) for x in ("2001:db8::1", "::1", "fe80::1ff:fe23:4567:890a", "1::", "::ffff:1")]
    texts = [f"from {a} ({a.exploded}), again [{a.exploded.upper()}]:80." for a in addresses]
    rows = rows_of(spark, texts)
    new = []
    for i, a in enumerate(addresses):
        if not any(c.isdigit() for c in str(a)):
            continue
        assert [ipaddress.IPv6Address(f["value"]) for f in rows[i].pii] == [a] * 3, (texts[i], rows[i].pii)
        assert {f["kind"] for f in rows[i].pii} == {"ipv6"}
        (fake,) = {f["pseudonym"] for f in rows[i].pii}
        assert rows[i].text == f"from {fake} ({fake}), again [{fake}]:80." and ipaddress.IPv6Address(fake) != a
        new.append((a.exploded, fake))
    assert len({f for _, f in new}) == len({a for a, _ in new})
    back = spark.createDataFrame(new, "v string, p string").select("v", pseudonyms.pseudonym(F.col("p"), F.lit("ipv6"), "k", back=True).alias("x"))
    assert all(r.v == r.x for r in back.collect())


def test_look_alikes_stay(spark):
    texts = [
        "std::vector and a::b and dead::beef",
        "at 12:30:45 or 12:30",
        "1:2:3:4:5:6:7:8:9 and 1:2:3:4:5:6:7::8",
        "12345::1 and 1::2::3",
        "::",
        "g::1x",
    ]
    rows = rows_of(spark, texts)
    for i, text in enumerate(texts):
        assert (rows[i].text, rows[i].pii) == (text, [])


def test_mapped_addresses_and_neighbours(spark):
    rows = rows_of(spark, ["::ffff:10.2.3.4 mail a@b.org 2001:db8::7", None, "2001:db8::7 " * 20_000])
    assert [f["kind"] for f in rows[0].pii] == ["ip", "email", "ipv6"] and rows[0].text.startswith("::ffff:")
    assert rows[1].text is None and len(rows[2].pii) == 20_000
    assert {f["pseudonym"] for f in rows[2].pii} == {rows[0].pii[2]["pseudonym"]}
