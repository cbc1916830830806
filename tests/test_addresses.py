import ipaddress
import random

from hitloom.functions.addresses import with_address_bits, with_cidr_parts

ODD = [
    "", "-", "a", "300.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.4 ", "::", "::1", "1::", ":::", "1:::2",
    "1::2::3", ":1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "12345::",
    "::ffff:1.2.3.4", "::1.2.3.400", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "FE80::A", "g::1", "1:2", ":",
    "2400:cb00::1:", "1.2.3.4::",
]


def expected(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return format(int(address), f"0{address.max_prefixlen}b")


def test_bits_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    texts = list(ODD)
    for _ in range(1500):
        v6 = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, ~(0xFFFFFFFF << 48), ~0xFFFF, 0xFFFF]))
        texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))), str(v6), v6.exploded.upper()]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = {r["ip"]: r["bits"] for r in with_address_bits(df, "ip").collect()}
    assert {t: b for t, b in got.items() if b != expected(t)} == {}


def test_cidr_parts(spark):
    cidrs = ["10.0.0.0/14", "2400:cb00::/32", "0.0.0.0/0", "1.2.3.4/33", "1.2.3.4", "x/8", "1.2.3.4/a", "::/0"]
    df = spark.createDataFrame([(c,) for c in cidrs], "cidr string")
    got = {r["cidr"]: (r["addr"], r["len"], r["family"], r["net_bits"]) for r in with_cidr_parts(df).collect()}
    assert got["10.0.0.0/14"] == ("10.0.0.0", 14, 32, "00001010000000")
    assert got["2400:cb00::/32"] == ("2400:cb00::", 32, 128, "00100100000000001100101100000000")
    assert got["0.0.0.0/0"][3] == got["::/0"][3] == ""
    assert len(got["1.2.3.4"][3]) == 32
    for bad in ("1.2.3.4/33", "x/8", "1.2.3.4/a"):
        assert got[bad][3] is None
