import itertools

import pytest

from sparkwarden.policy import BOT, CLEAN, TOP, A, Policy, PolicyViolation, T, from_json, parse, to_json

SOME = [CLEAN, *map(parse, ("bot", "top", "T{+:1}", "A{sum>=2}", "A{sum>=5, mean>=3}", "T{+:1} => bot", "A{sum>=2} => T{dt.offset_by:5s}", "N{0.5,}"))]


def test_order_and_chain():
    assert parse("A{sum>=2}").le(parse("A{sum>=5}")) and not parse("A{sum>=5}").le(parse("A{sum>=2}"))
    with pytest.raises(ValueError):
        Policy((TOP,)).then(BOT).then(TOP)
    assert parse("top").join(parse("T{f:1}")) == Policy((TOP, T("f", 1)))


@pytest.mark.parametrize(("a", "b"), itertools.product(SOME, SOME))
def test_join(a, b):
    assert a.join(b) == b.join(a)
    assert a.join(a) == a
    assert from_json(to_json(a)) == a


def test_downgrade():
    off = parse("T{dt.offset_by:5s}")
    assert off.downgrade(T("dt.offset_by", "5s"), "") == CLEAN
    with pytest.raises(PolicyViolation):
        off.downgrade(T("dt.offset_by", "4s"), "")
    assert off.downgrade(A("sum", k=9), "") == off
    with pytest.raises(PolicyViolation):
        parse("A{sum>=2}").downgrade(A("sum", k=1), "")
    assert parse("A{sum>=2}").downgrade(A("sum", k=5), "") == CLEAN
    with pytest.raises(PolicyViolation):
        parse("A{sum>=20}").downgrade(T("sub", 1), "")
    assert parse("T{+:1} => A{max>=5}").downgrade(T("add", 1.0), "") == parse("A{max>=5}")
