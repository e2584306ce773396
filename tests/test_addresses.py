"""Addresses and networks of both families against Python's ipaddress."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from eventlens.functions.addresses import address_key, masked, network_parts, next_key
from eventlens.operators import enrich as E

ODD = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", "::", "::1", "1::", ":1", "1:", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1::1.2.3.256", "ABCD::eF", "12345::", "g::", "1:2:3", "::1.2.3.4:5", "1.2.3.4::", "x", None]


def number(text):
    try:
        a = ipaddress.ip_address(text.strip())
    except ValueError:
        return None
    return int(a) if a.version == 6 else (0xFFFF << 32) + int(a)


def random_address(rng):
    if rng.random() < 0.5:
        return str(ipaddress.IPv4Address(rng.randrange(1 << 32)))
    n = 0
    for _ in range(8):
        n = n << 16 | rng.choice([0, 0, 1, 0xFFFF, rng.randrange(1 << 16)])
    a = ipaddress.IPv6Address(n)
    return rng.choice([str(a), a.exploded, str(a).upper()])


def test_keys(spark):
    rng = random.Random(1)
    rows = [(k, t) for k, t in enumerate(ODD + [random_address(rng) for _ in range(400)])]
    got = spark.createDataFrame(rows, "k int, t string").select("k", address_key(F.col("t")).alias("key")).collect()
    for r in got:
        want = None if rows[r.k][1] is None else number(rows[r.k][1])
        assert r.key == (None if want is None else f"{want:032x}"), rows[r.k]


def test_network_bounds(spark):
    rng = random.Random(2)
    texts = [f"{a}/{rng.randint(0, 32 if '.' in a and ':' not in a else 128)}" for a in (random_address(rng) for _ in range(300))] + ["::/0", "0.0.0.0/0", "1.2.3.4", "::5", "1.2.3.4/33", "::/129", "1.2.3.4/", "1.2.3.4/-1", "1.2.3.4/a", "/8", None]
    key, length = network_parts(F.col("t"))
    first, last = masked(key, length, "0"), masked(key, length, "f")
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", length.alias("n"), first.alias("first"), last.alias("last"), next_key(last).alias("next")).collect()
    for r in got:
        t = texts[r.k]
        try:
            net = ipaddress.ip_network(t, strict=False) if t and not t.endswith("/") else None
        except ValueError:
            net = None
        if net is None:
            assert r.n is None and r.first is None and r.next is None, t
            continue
        base = (0xFFFF << 32) if net.version == 4 else 0
        lo, hi = base + int(net.network_address), base + int(net.broadcast_address)
        assert (r.n, r.first, r.last) == (net.prefixlen + (96 if net.version == 4 else 0), f"{lo:032x}", f"{hi:032x}"), t
        assert r.next == (None if hi == (1 << 128) - 1 else f"{hi + 1:032x}"), t


@pytest.mark.parametrize("group_rows", [None, 50])
def test_narrowest_network(spark, group_rows):
    rng = random.Random(3)
    nets = {}
    for _ in range(150):
        a = f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}" if rng.random() < 0.5 else f"2001:db8:{rng.randrange(3)}::{rng.randrange(300):x}"
        six = ":" in a
        net = ipaddress.ip_network(f"{a}/{rng.choice([0, 32, 48, 120, 127, 128] if six else [0, 8, 16, 23, 24, 30, 32])}", strict=False)
        nets.setdefault(net, f"n{len(nets):03}")
    nets[ipaddress.ip_network("255.255.255.255/32")] = "top"
    nets[ipaddress.ip_network("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128")] = "end"
    rows = [(str(n), name) for n, name in nets.items()] + [("bad", "x"), (None, "y"), (str(next(iter(nets))), "zz")]
    asked = [f"10.{rng.randrange(4)}.{rng.randrange(5)}.{rng.randrange(256)}" for _ in range(150)] + [f"2001:db8:{rng.randrange(4)}::{rng.randrange(320):x}" for _ in range(150)]
    asked += ["::ffff:10.1.1.1", "255.255.255.255", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::", "nonsense"]
    networks = spark.createDataFrame(rows, "network string, name string")
    got = {r.address: r.name for r in E.locate_addresses(spark.createDataFrame([(a,) for a in set(asked)], "address string"), networks, ["name"], group_rows=group_rows).collect()}
    keyed = [(int(n.network_address) + (0xFFFF << 32 if n.version == 4 else 0), int(n.broadcast_address) + (0xFFFF << 32 if n.version == 4 else 0), name) for n, name in nets.items()]
    for a in set(asked):
        n = number(a)
        inside = [(hi - lo, name) for lo, hi, name in keyed if n is not None and lo <= n <= hi]
        assert got.get(a) == (min(inside)[1] if inside else None), a


def test_no_networks(spark):
    networks = spark.createDataFrame([], "network string, country string, city string, lat double, lon double, region string")
    out = spark.createDataFrame([(1, "10.0.0.1")], "event_id long, ip string").transform(E.enrich_geo(networks)).collect()
    assert out[0].ip_geo_country is None
