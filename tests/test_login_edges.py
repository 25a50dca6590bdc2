"""Edge rows of the sign-in filter and the address allowlist (FIXTURES §1)."""

from skywatch import schemas
from skywatch.operators import logins


def rec(eid, name="ConsoleLogin", ip="8.8.8.8", resp=("__default__",), ident=True, extra=True,
        source="signin.amazonaws.com", etype="AwsConsoleSignIn"):
    if resp == ("__default__",):
        resp = {"SwitchRole": None, "ConsoleLogin": "Success"} if name != "SwitchRole" else {"SwitchRole": "Success", "ConsoleLogin": None}
    return {
        "eventVersion": "1.05",
        "userIdentity": {"type": "IAMUser", "principalId": "p", "arn": "arn:x", "accountId": "a", "userName": "u"} if ident else None,
        "eventTime": "2024-01-01T00:00:00Z", "eventSource": source, "eventName": name, "awsRegion": "r",
        "sourceIPAddress": ip, "userAgent": "ua", "requestParameters": None,
        "responseElements": resp,
        "additionalEventData": {"SwitchFrom": "arn:from", "RedirectTo": None, "LoginTo": None,
                                "MobileVersion": None, "MFAUsed": None} if extra else None,
        "eventID": str(eid), "eventType": etype, "recipientAccountId": "acct"}


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.TRAIL_RECORD)


def ids(df):
    return sorted(int(r.eventID) for r in df.select("eventID").collect())


def test_type_and_success_filters(spark):
    rows = [rec(1), rec(2, name="CheckMfa"), rec(3, name=None), rec(4, resp=None),
            rec(5, resp={"SwitchRole": None, "ConsoleLogin": "Failure"}), rec(6, source="other"),
            rec(7, etype="AwsApiCall"), rec(8, name="SwitchRole", resp={"SwitchRole": "Failure", "ConsoleLogin": None})]
    got = ids(logins.signin_events(frame(spark, rows)))
    # NULL eventName is kept (JavaScript != keeps it); NULL responseElements counts as success.
    assert got == [1, 3, 4]


def test_user_label_unknowns(spark):
    rows = [rec(1, ident=False), rec(2, name="SwitchRole", extra=False), rec(3, name="SwitchRole")]
    out = {r.eventID: r.user for r in logins.login_alerts(spark, frame(spark, rows), [], keep=["eventID"]).collect()}
    assert out["1"] == "[unknown] - [unknown]"
    assert out["2"] == "IAMUser - arn:x from [unknown]"
    assert out["3"] == "IAMUser - arn:x from arn:from"


def test_address_kinds(spark):
    rows = [rec(1, ip="10.0.0.5"), rec(2, ip="10.0.1.5"), rec(3, ip="signin.amazonaws.com"),
            rec(4, ip="2001:db8::5"), rec(5, ip="2001:db8::1:5"), rec(6, ip="::ffff:10.0.0.7"),
            rec(7, ip="10.0.0.256"), rec(8, ip="192.168.1.1"), rec(9, ip=None)]
    flagged = ids(logins.login_alerts(spark, frame(spark, rows), ["10.0.0.0/24", "2001:db8::/112", "192.168.1.1"],
                                      keep=["eventID"]))
    # host names, out-of-range and invalid text are flagged; v4-mapped IPv6 counts as IPv4
    assert flagged == [2, 3, 5, 7, 9]


def test_empty_allowlist_flags_everything(spark):
    rows = [rec(1, ip="10.0.0.5"), rec(2, ip="1.1.1.1")]
    assert ids(logins.login_alerts(spark, frame(spark, rows), [], keep=["eventID"])) == [1, 2]


def test_any_length_of_list_in_one_pass(spark):
    from skywatch.operators.allowlist import intervals, outside_ranges
    ips = ["10.0.0.5", "10.0.1.5", "192.168.7.9", "2001:db8::5", "2001:db8::1:5", "::ffff:10.0.0.7", "bad", None,
           "172.16.3.4", "8.8.8.8", "2001:DB8::5%eth0", "2001:db8::0.0.0.9", "1:2:3:4:5:6:7::", ":::", "1::2::3", "::1.2.3.999"]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id int, ip string")
    ranges = ["10.0.0.0/24", "2001:db8::/112", "192.168.7.9", "172.16.0.0/12"]
    long = ranges + [f"100.64.{i}.0/25" for i in range(200)] + [f"2001:db9:{i:x}::/48" for i in range(0, 400, 2)]
    assert intervals(["10.0.0.0/25", "10.0.0.128/25", "10.0.1.0", "::/1", "8000::/1"]) == [(4, 10 << 24, (10 << 24) + 256), (6, 0, 2**128 - 1)]
    for some in (ranges, long):
        out = outside_ranges(df, "ip", some)
        # flagged: out-of-range IPv4, IPv6 outside the /112, junk, NULL, 8.8.8.8
        assert sorted(r.id for r in out.collect()) == [1, 4, 6, 7, 9, 12, 13, 14, 15]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Join", "Exchange", "Python"))


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_v4 = st.integers(0, 2**32 - 1)
_v6 = st.integers(0, 2**128 - 1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(_v4.map(lambda n: ("v4", n)), _v6.map(lambda n: ("v6", n)),
                          _v4.map(lambda n: ("mapped", n))), min_size=5, max_size=30),
       st.lists(st.one_of(st.tuples(st.just(4), _v4, st.integers(0, 32)),
                          st.tuples(st.just(6), _v6, st.integers(0, 128))), min_size=1, max_size=6))
def test_allowlist_matches_ipaddress_model(spark, addrs, nets):
    """C2 against Python's ipaddress: an address is allowed if any range
    holds it; v4-mapped IPv6 is checked as its IPv4 address."""
    import ipaddress

    from skywatch.operators.allowlist import outside_ranges
    ranges = [str((ipaddress.IPv4Network if v == 4 else ipaddress.IPv6Network)((n, p), strict=False))
              for v, n, p in nets]
    texts = []
    for kind, n in addrs:
        if kind == "v4":
            texts.append(str(ipaddress.IPv4Address(n)))
        elif kind == "v6":
            texts.append(str(ipaddress.IPv6Address(n)))
        else:
            texts.append("::ffff:" + str(ipaddress.IPv4Address(n)))
    parsed = [ipaddress.ip_network(r) for r in ranges]

    def allowed(t):
        a = ipaddress.ip_address(t)
        if a.version == 6 and a.ipv4_mapped is not None:
            a = a.ipv4_mapped
        return any(a.version == net.version and a in net for net in parsed)

    model = sorted(i for i, t in enumerate(texts) if not allowed(t))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, ip string")
    got = sorted(r.id for r in outside_ranges(df, "ip", ranges).collect())
    assert got == model
