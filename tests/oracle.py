"""A slow, plain matcher to compare with."""


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def score(a: str, b: str) -> float:
    return distance(a, b) / max(len(a), len(b)) if a or b else 0.0


def pairs(names: list[str], t: float) -> set:
    clean = [" ".join(n.lower().split()) for n in names]
    return {(i, j, score(clean[i], clean[j])) for i in range(len(names)) for j in range(i + 1, len(names)) if score(clean[i], clean[j]) <= t}
