"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import regex

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, n: int = 5) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def components(rows: list[tuple[int, str | None]], percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id: (number of shingles, smallest doc_id of the component)."""
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by_set, holders = {}, defaultdict(list)
    for k, own in sets.items():
        if own:
            first = by_set.setdefault(frozenset(own), k)
            if first == k:
                for x in own:
                    holders[x].append(k)
            else:
                root[find(k)] = find(first)
    for k, own in sets.items():
        if not own or by_set[frozenset(own)] != k:
            continue
        common: dict[int, int] = defaultdict(int)
        for x in own:
            for other in holders[x]:
                if other > k:
                    common[other] += 1
        for other, c in common.items():
            if 100 * c >= percent * (len(own) + len(sets[other]) - c):
                root[find(other)] = find(k)
    least: dict[int, int] = {}
    for k in sets:
        least[find(k)] = min(k, least.get(find(k), k))
    return {k: (len(sets[k]), least[find(k)]) for k in sets}


def _permuted(chars: list[tuple[int, int]], key: str, kind: str) -> list[int]:
    """Feistel rounds over (value, class) of characters; new values. A class is (first code point, size)."""
    half = len(chars) // 2
    sides = [[list(x) for x in chars[:half]], [list(x) for x in chars[half:]]]
    for i in range(8):
        own, other = sides[i % 2], sides[1 - i % 2]
        said = ",".join(str(v + c[0]) for v, c in other)
        digest = hashlib.sha256(f"{key}|{kind}|{i}|{len(own)}|{said}".encode()).hexdigest()
        for j, x in enumerate(own):
            at = (j * 4) % 60
            x[0] = (x[0] + int(digest[at : at + 4], 16)) % x[1][1]
    return [v for v, _ in sides[0] + sides[1]]


def _characters(text: str, key: str, kind: str, classes: list[tuple[int, int]]) -> str:
    of = [next((c for c in classes if c[0] <= ord(x) < c[0] + c[1]), None) for x in text]
    new = iter(_permuted([(ord(x) - c[0], c) for x, c in zip(text, of, strict=True) if c], key, kind))
    return "".join(chr(next(new) + c[0]) if c else x for x, c in zip(text, of, strict=True))


def _product(left: int, right: int, a: int, b: int, key: str, kind: str) -> tuple[int, int]:
    for i in range(8):
        x = int(hashlib.sha256(f"{key}|{kind}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
        left, right = ((left + x % a) % a, right) if i % 2 == 0 else (left, (right + x % b) % b)
    return left, right


def _luhn(number: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10


def _filled(form: str, new: str) -> str:
    left = iter(new)
    return "".join(next(left) if "0" <= x <= "9" else x for x in form)


def _day(text: str, form: str) -> date | None:
    try:
        found = datetime.strptime(text, form).date()
    except ValueError:
        return None
    return found if 1600 <= found.year <= 2399 else None


def pseudonym(x: str, key: str, classes: list[tuple[int, int]]) -> tuple[str | None, str]:
    """Kind and pseudonym of a find, None and the find itself if it is not valid."""
    numbers = re.sub("[^0-9]", "", x)
    if "@" in x:
        local, at, domain = x.partition("@")
        new = _characters(local, key, "email", classes)
        return ("email", new + at + domain) if any(a <= ord(c) < a + n for c in local for a, n in classes) else (None, x)
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", x) and max(map(len, x.split("."))) <= 3:
        o = list(map(int, x.split(".")))
        if max(o) > 255:
            return None, x
        a, b = _product(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return "ip", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}", x):
        forms = ["%Y-%m-%d"] if x[4] == "-" else [f"%d{x[2]}%m{x[2]}%Y", *(["%m/%d/%Y"] if x[2] == "/" else [])]
        # a string that is a day of any year day first is not read month first
        for form in forms:
            try:
                datetime.strptime(x, form)
            except ValueError:
                continue
            found = _day(x, form)
            if found is None:
                return None, x
            start = date(1600, 1, 1)
            cycle, inside = divmod((found - start).days, 146097)
            a, b = _product(inside // 773, inside % 773, 189, 773, key, "date")
            return "date", (start + timedelta(days=cycle * 146097 + a * 773 + b)).strftime(form)
        return None, x
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", x):
        area, group, serial = map(int, x.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None, x
        a, b = _product(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        a += 1
        return "ssn", f"{a + (a >= 666):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if x[0] in "+(" or re.match(r"[0-9]{3}[.-][0-9]{3}[.-]", x) or re.fullmatch(r"0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}", x):
        if not 8 <= len(numbers) <= 15:
            return None, x
        m = re.match(r"(\+[0-9]{1,3})[ .(-]", x)
        code = m[1] if m else x[0] if x[0] in "123456789" else x[:2]
        rest = x[len(code) :]
        return "phone", code + _filled(rest, _characters(re.sub("[^0-9]", "", rest), key, "phone", classes[:1]))
    mod97 = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    if x[0].isalpha():
        plain = x.replace(" ", "")
        own, country = plain[4:], plain[:2]
        if mod97(own + plain[:4]) != 1:
            return None, x
        own = _filled(own, _characters(re.sub("[^0-9]", "", own), key, "iban", classes[:1]))
        made = f"{country}{98 - mod97(own + country + '00'):02d}{own}"
        return "iban", _filled(x, re.sub("[^0-9]", "", made))
    if _luhn(numbers):
        return None, x
    made = numbers[0] + _characters(numbers[1:-1], key, "card", classes[:1])
    return "card", _filled(x, made + str(-_luhn(made + "0") % 10))


def pseudonymised(text: str, key: str, pattern: str, classes: list[tuple[int, int]]) -> tuple[str, dict[str, int]]:
    counts: dict[str, int] = defaultdict(int)

    def put(m) -> str:
        kind, new = pseudonym(m[0], key, classes)
        if kind:
            counts[kind] += 1
        return new

    return regex.sub(pattern, put, text), dict(counts)


def code_length(texts: list[str], text: str, order: int = 3) -> float:
    """The code length of `text` after `texts`, byte by byte."""
    counts: dict[bytes, Counter] = {}
    for t in texts:
        raw = t.encode()
        for i in range(len(raw)):
            for k in range(min(i, order) + 1):
                counts.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    raw, total = text.encode(), 0.0
    for i in range(len(raw)):
        for k in range(min(i, order), -1, -1):
            c = counts.get(raw[i - k : i])
            if not c:
                total += 8 if k == 0 else 0
                continue
            whole = sum(c.values()) + len(c)
            if raw[i] in c:
                total += math.log2(whole / c[raw[i]])
                break
            total += math.log2(whole / len(c)) + (8 if k == 0 else 0)
    return total
