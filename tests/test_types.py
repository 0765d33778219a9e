import random

import pytest

from seqwell.errors import InterpretError, RangeError, StatementError
from seqwell.functions import literals as lit
from seqwell.functions import types as t
from seqwell.plans.language import Statement, evaluate, parse


def test_text_form_and_sizes():
    for text, size in [("u8", 1), ("[10][11][12] u32", 5280), ("struct { a u8, b union { c i64, d f16 }, c [10] i32 }", 49), ("enum { A, B }", 1), ("cf256", 32)]:
        made = t.parse(text)
        assert t.parse(str(made)) == made and made.size == size and t.deserialize(made.serialize()) == made


@pytest.mark.parametrize("bad", ["", "u7", "struct { }", "struct { a u8, a u8 }", "[0] u8", "enum { }", "u8 u8", "[x] u8"])
def test_bad_types(bad):
    with pytest.raises(StatementError):
        t.parse(bad)


def test_random_types_survive_a_round_trip():
    rng = random.Random(3)
    for _ in range(300):
        made = t.random_type(rng)
        made.validate()
        assert t.equal(t.parse(str(made)), made) and made.size > 0
        made.spark()


def test_packing():
    s = t.parse("struct { a u16, b [2] i8, e enum { X, Y }, z cf64, u union { p u8, q f64 } }")
    value = {"a": 513, "b": [-1, 2], "e": "Y", "z": {"re": 1.5, "im": -2.0}, "u": {"q": 0.25}}
    raw = s.pack(value)
    assert len(raw) == s.size and raw[:2] == b"\x01\x02" and s.offset("e") == 4
    assert s.unpack(raw) == value | {"u": {"p": 0, "q": 0.25}}
    with pytest.raises(RangeError):
        t.parse("u8").pack(256)


RANGES = [(255, "u8", True), (256, "u8", False), (-1, "u16", False), (-128, "i8", True), (1.5, "u8", True), (70000.0, "f16", False), (1e30, "f64", True), (1 + 2j, "cu16", True), (-1 + 0j, "cu16", False), (3, "ci16", True), (True, "u8", True), (True, "u16", False), ("ab", "[2] u8", True), ("abc", "[2] u8", False), ([1, 2], "[2] u8", True), ([1], "[2] u8", False), ({"a": 1}, "struct { a u8 }", True), ({"a": 1, "b": 2}, "struct { a u8 }", False), ({"b": 1}, "union { a u8, b i8 }", True), ({"a": 1, "b": 1}, "union { a u8, b i8 }", False)]


@pytest.mark.parametrize("value,text,good", RANGES)
def test_what_fits(value, text, good):
    assert lit.can_store(value, t.parse(text)) is good


CASES = [("1 + 2 * 3", 7), ("-5 / 3", -1), ("-5 % 3", 1), ("5 % -3", -1), ("-5.5 % 2", 0.5), ("5.5 % -2", -0.5), ("7 / 2.0", 3.5), ("1.0 / 0", float("inf")), ("3 % 0.0", float("inf")), ("\"a\" + \"b\"", "ab"), ("[1] + [2, 3]", [1, 2, 3]), ("{a: 1} + {b: 2}", {"a": 1, "b": 2}), ("{a: 1, b: 2} == {b: 2, a: 1}", False), ("true ^ true", False), ("6 ^ 3", 5), ("true | 2", 3), ("~true", -2), ("!0 && \"x\" || false", True), ("\"ab\" < \"b\"", True), ("(1 + 2) * 3", 9), ("1 != 1.5", True), ("-(-3)", 3)]


@pytest.mark.parametrize("text,want", CASES)
def test_expressions(text, want):
    got = evaluate(text)
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize("text", ["true + 1", "\"a\" - \"b\"", "[1] < [2]", "1 == \"a\"", "1.5 ^ 1", "-true", "~1.5", "1 +", "(1", "{a: 1, a: 2}"])
def test_expressions_that_fail(text):
    with pytest.raises(StatementError):
        evaluate(text)


def test_other_failures():
    with pytest.raises(InterpretError):
        evaluate("{a: 1} + {a: 2}")
    for text in ("2147483647 + 1", "1 / 0", "1 % 0", "99999999999"):
        with pytest.raises(RangeError):
            evaluate(text)
    assert lit.binary(">", 3 + 4j, 24) and not lit.binary(">", 3 + 4j, 25)


def test_statements():
    good = parse("create v struct { a u8, b [2] f32, }; insert v 0 10; insert v 8080 5 10; insert v:1 3 (4); read v.b[0:2] 1:9:2; take v[b, a] 3; remove v ::2; close v:1; delete v;")
    assert all(isinstance(s, Statement) for s in good) and [s.verb for s in good] == ["create", "insert", "insert", "insert", "read", "take", "remove", "close", "delete"]
    assert (good[2].port, good[2].start, good[2].length) == (8080, 5, 10) and (good[3].port, good[3].length) == (1, 4)
    assert (good[4].start, good[4].stop, good[4].stride) == (1, 9, 2) and len(good[5].paths) == 2 and good[6].stride == 2


def test_recovery():
    found = parse("insert 1 2; ; insert v 0 10; what? read v; insert v $ 1; delete v;")
    kinds = [isinstance(s, Statement) for s in found]
    assert kinds == [False, False, True, False, False, True]
