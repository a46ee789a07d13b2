"""Notices that stand side by side, with edits in any of them."""

import itertools

from veristrata.llm import license_scan

EXACT, ONE, TWO = "released under the mit license", "released undr the mit license", "releasd undr the mit license"


def test_weaker_notices_beside_better_ones():
    scanner = license_scan.Scanner((("released under the mit license", "mit"),))
    for n in (1, 2, 3):
        for said in itertools.product((EXACT, ONE, TWO), repeat=n):
            for between in (" ", " and ", " or else "):
                text = between.join(said)
                want, at = [], 0
                for x in said:
                    want.append((at, at + len(x), (EXACT, ONE, TWO).index(x)))
                    at += len(x) + len(between)
                assert [(s[0], s[1], s[3]) for s in scanner.find(text)] == want, text
