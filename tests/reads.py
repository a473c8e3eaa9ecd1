import random


def random_read(rng, length):
    return "".join(rng.choice("ACGT") for _ in range(length))


def mutate(rng, read, edits):
    letters = list(read)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        kind = rng.choice("sssid")
        if kind == "s":
            letters[at] = rng.choice("ACGT")
        elif kind == "i":
            letters.insert(at, rng.choice("ACGT"))
        elif len(letters) > 20:
            del letters[at]
    return "".join(letters)


def families(seed, n_families, per_family, length, edits):
    """Distinct reads, a handful of edits away from the base of their family."""
    rng = random.Random(seed)
    found = {}
    for family in range(n_families):
        base = random_read(rng, length)
        for _ in range(per_family):
            found.setdefault(mutate(rng, base, rng.randint(0, edits)), family)
    return found
