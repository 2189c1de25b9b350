"""Brute-force versions of pipeline stages over a few texts in memory."""

from test_decontaminate import brute
from test_near_dedup import brute_kept as kept_rows


def brute_kept(texts):
    """One document of each group whose five-word shingles are alike at 0.8 or more."""
    return {i for _, i in kept_rows(list(texts.items()))}


def brute_trimmed(texts, size=20):
    seen, out = set(), {}
    for i in sorted(texts):
        words, gone = texts[i].encode().split(), set()
        for at in range(len(words) - size + 1):
            window = tuple(words[at:at + size])
            if window in seen:
                gone |= set(range(at, at + size))
            seen.add(window)
        out[i] = b" ".join([w for j, w in enumerate(words) if j not in gone]).decode() if gone else texts[i]
    return out


def brute_decontaminated(texts, items):
    return {r[0] for r in brute(list(texts.items()), items) if not r[5]}
