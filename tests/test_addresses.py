import ipaddress
import random

from pyspark.sql import functions as F

from pagewarden.functions import addresses as A
from pagewarden.functions import urls as U


def generated(n=1500):
    rng = random.Random(12)
    out = ["1.2.3", "256.1.1.1", "01.2.3.4", "1.2.3.4.5", "", ":", ":::", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1.2.3.256", "[::1]", "fe80::1%eth0", "::", "::ffff:10.0.0.1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "a.test", "1.2.3.4:80"]
    for _ in range(n):
        six = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), rng.getrandbits(32), rng.getrandbits(48), 0xFFFF << 32 | rng.getrandbits(32), rng.getrandbits(16) << 112 | rng.getrandbits(16)]))
        out += [str(ipaddress.IPv4Address(rng.getrandbits(32))), str(six), six.exploded.upper()]
    return out


def known(text):
    try:
        ip = ipaddress.ip_address(text.strip("[]").split("%")[0])
    except ValueError:
        return None
    return f"{int(ip) if ip.version == 6 else int(ip) | 0xFFFF << 32:032x}"


def test_addresses_are_those_of_the_library_and_compare_like_numbers(spark):
    texts = generated()
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").withColumn("a", A.canonical(F.col("t")))
    rows = {r.t: r for r in df.withColumn("r", A.inside(F.col("a"), A.RESERVED)).collect()}
    assert {t: rows[t].a for t in texts} == {t: known(t) for t in texts} and rows[None].a is None
    networks = [ipaddress.ip_network(n) for n in A.RESERVED]
    for t in texts:
        if rows[t].a is not None:
            ip = ipaddress.IPv6Address(int(rows[t].a, 16))
            ip = ip.ipv4_mapped or ip
            assert rows[t].r == any(ip in n for n in networks if n.version == ip.version), t
            if not (ip.version == 6 and (ip in ipaddress.ip_network("2001::/23") or ip in ipaddress.ip_network("::/8"))) and t not in ("192.0.0.9", "192.0.0.10"):
                assert rows[t].r == (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved), t


def test_ranges_are_joined_by_blocks(spark):
    rng = random.Random(5)
    numbers = [0, 2**128 - 1, *(rng.getrandbits(128) for _ in range(150)), *(0xFFFF << 32 | rng.getrandbits(12) for _ in range(200))]
    ends = [(0, 2**128 - 1), (5, 5), (0xFFFF << 32, (0xFFFF << 32) + 1000), (2**127 - 7, 2**127 + 9)] + [tuple(sorted((rng.getrandbits(128), rng.getrandbits(128)))) for _ in range(20)]
    text = lambda n: f"{n:032x}"
    addresses = spark.createDataFrame([(i, text(n)) for i, n in enumerate(numbers)] + [(-1, None)], "id int, address string")
    ranges = spark.createDataFrame([(k, text(a), text(b)) for k, (a, b) in enumerate(ends)], "k int, first string, last string")
    got = sorted((r.id, r.k) for r in A.ranged(addresses, ranges).collect())
    assert got == sorted((i, k) for i, n in enumerate(numbers) for k, (a, b) in enumerate(ends) if a <= n <= b)


def test_destinations(spark):
    bad = ["http://127.0.0.1/", "http://[::1]/", "http://[::ffff:10.0.0.1]:80/", "http://[0:0:0:0:0:ffff:c0a8:101]/", "https://u@[fe80::1]/x", "http://localhost/", "ftp://a.test/", "http://10.1.2.3:8080/", "http://[fd00::5]"]
    good = ["http://8.8.8.8/", "https://[2606:4700::1111]/", "http://a.test/", "https://[::ffff:8.8.8.8]/", "http://198.51.99.1/"]
    rows = {r.u: r.s for r in spark.createDataFrame([(u,) for u in bad + good], "u string").select("u", U.safe_destination(F.col("u")).alias("s")).collect()}
    assert [u for u in bad if rows[u]] == [] and [u for u in good if not rows[u]] == []
