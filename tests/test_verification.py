"""Verdicts over time, strategies by name; networks of any number and depth."""

from __future__ import annotations

import datetime
import ipaddress
import random

from pyspark.sql import functions as F

from postmill.operators import frontier, verification

NOW = datetime.datetime(2024, 6, 1)


def test_fresh_verdicts_stand_and_stale_ones_are_redone(spark):
    people = [(1, "A@x.example "), (2, "a@x.example"), (3, "b@x.example"), (4, None), (5, " "), (6, "c@x.example"), (7, "d@x.example")]
    contacts = spark.createDataFrame(people, "contact_id long, email string")
    days = lambda n: NOW - datetime.timedelta(days=n)
    old = [("a@x.example", "valid", 0.9, "", days(3)), ("a@x.example", "invalid", 0.0, "", days(90)), ("b@x.example", "valid", 0.9, "", days(90)), ("c@x.example", "valid", 0.9, "", days(-5)), ("d@x.example", "not_checked", 0.0, "", days(1))]
    verdicts = spark.createDataFrame(old, "email string, status string, confidence double, reason string, checked_at timestamp_ntz")
    seen = []

    def counting(emails):
        seen.extend(r.email for r in emails.collect())
        return verification.vendor_verifier(spark.createDataFrame([("b@x.example", '{"status": "catch_all"}'), ("d@x.example", "broken")], "email string, body string"))(emails)

    verification.register_verifier("counting", counting)
    as_of = F.lit(NOW).cast("timestamp_ntz")
    out, added = verification.verify_contacts(contacts, verdicts, "counting", as_of)
    got = {r.contact_id: (r.email_verification, r.email_verified_at) for r in out.collect()}
    assert got == {1: ("valid", days(3)), 2: ("valid", days(3)), 3: ("risky", NOW), 4: ("not_checked", None), 5: ("not_checked", None), 6: ("unknown", NOW), 7: ("unknown", NOW)}
    assert sorted(seen) == ["b@x.example", "c@x.example", "d@x.example"]
    again, more = verification.verify_contacts(contacts, verdicts.unionByName(added), "counting", as_of)
    assert more.count() == 0 and {r.contact_id: (r.email_verification, r.email_verified_at) for r in again.collect()} == got
    one, few = verification.verify_contacts(contacts, verdicts, "none", as_of, ids=spark.createDataFrame([(3,)], "contact_id long"))
    assert [r.email for r in few.collect()] == ["b@x.example"] and one.filter("contact_id = 6 and email_verification = 'not_checked'").count() == 1
    assert verification.verify_contacts(contacts.limit(0), verdicts.limit(0), "none", as_of)[0].count() == 0


def test_networks_of_any_number_and_depth(spark):
    rng = random.Random(9)
    nets = [ipaddress.ip_network((rng.getrandbits(32) >> (32 - n) << (32 - n), n)) for n in (rng.randrange(4, 33) for _ in range(300))]
    nets += [ipaddress.ip_network((rng.getrandbits(128) >> (128 - n) << (128 - n), n)) for n in (rng.randrange(8, 129) for _ in range(150))]
    ips = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(300)] + [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(200)]
    for net in rng.sample(nets, 150):  # ends of ranges, and what lies beside them
        for at in (int(net.network_address) - 1, int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1):
            if 0 <= at < 2**net.max_prefixlen:
                ips.append(str(ipaddress.IPv4Address(at) if net.version == 4 else ipaddress.IPv6Address(at)))
    ips = list(dict.fromkeys(ips))
    table = frontier.network_table(spark, [str(n) for n in nets])
    out = frontier.ip_cidr_join(spark.createDataFrame([(i,) for i in [*ips, "no address", None]], "ip string"), table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = {r.ip: r.is_public for r in out.collect()}
    holes = [ipaddress.ip_network(h) for h in frontier.fixed.GLOBAL_EXCEPTIONS]

    def blocked(ip):
        ip = ipaddress.ip_address(ip)
        return any(ip in n and not any(h.version == n.version and h.subnet_of(n) and ip in h for h in holes) for n in nets if n.version == ip.version)

    assert got.pop("no address") is False and got.pop(None) is False
    assert {i for i, public in got.items() if not public} == {i for i in ips if blocked(i)}
    merged = sorted((r.low, r.high) for r in frontier.disjoint_ranges(table).collect())
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))
