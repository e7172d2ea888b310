"""A plain version of the URL models: counts in dictionaries, chances by the recursion itself."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

_SIGNS = "abcdefghijklmnopqrstuvwxyz0.-/?=&%_:#~"
EDGE = 256


def class_of(symbol: int) -> str:
    if symbol == EDGE:
        return "edge"
    sign = chr(symbol).lower() if symbol < 128 else "other"
    sign = "0" if sign in "0123456789" else sign
    return sign if sign in _SIGNS else "other"


SHARING = Counter(map(class_of, range(257)))


class PlainModel:
    def __init__(self, urls: list[str]):
        self.n, self.after, self.single = Counter(), defaultdict(Counter), Counter()
        for u in urls:
            data = [EDGE] * 3 + list(u.encode()) + [EDGE]
            for i in range(3, len(data)):
                self.after[tuple(data[i - 3 : i])][data[i]] += 1
                self.single[data[i]] += 1
                kinds = tuple(map(class_of, data[i - 3 : i + 1]))
                for k in range(4):
                    self.after[("classes", *kinds[3 - k : 3])][kinds[3]] += 1

    def leaning(self, context: tuple, symbol, p: float) -> float:
        seen = self.after.get(context)
        return (seen[symbol] + len(seen) * p) / (sum(seen.values()) + len(seen)) if seen else p

    def chance(self, before: tuple, symbol: int) -> float:
        kinds, kind = tuple(map(class_of, before)), class_of(symbol)
        p = 1 / len(SHARING)
        for k in range(4):
            p = self.leaning(("classes", *kinds[3 - k :]), kind, p)
        same = {s: n for s, n in self.single.items() if class_of(s) == kind}
        within = (same.get(symbol, 0) + len(same) / SHARING[kind]) / (sum(same.values()) + len(same)) if same else 1 / SHARING[kind]
        return self.leaning(before, symbol, p * within)


def score(models: dict[int, PlainModel], url: str) -> float:
    """The mean log ratio per byte and the closing boundary."""
    data = [EDGE] * 3 + list(url.encode()) + [EDGE]
    each = [math.log(models[1].chance(tuple(data[i - 3 : i]), data[i]) / models[0].chance(tuple(data[i - 3 : i]), data[i])) for i in range(3, len(data))]
    return sum(each) / len(each)
