"""An independent assembler in plain Python: the same graph, walked edge by edge."""

from collections import defaultdict

PAIR = str.maketrans("ACGT", "TGCA")


def rc(x):
    return x.translate(PAIR)[::-1]


def canon(x):
    return min(x, rc(x))


def count(reads, k):
    """{canonical k-mer: {(strand, base): n}}"""
    table = defaultdict(lambda: defaultdict(int))
    for seq in reads:
        for i in range(len(seq) - k + 1):
            x = seq[i : i + k]
            here = table[canon(x)]
            forward = 0 if x == canon(x) else 1
            if i + k < len(seq):
                here[forward, seq[i + k]] += 1
            if i:
                here[1 - forward, rc(seq[i - 1])] += 1
    return table


def graph(reads, k, cutoff=1):
    kept = {x: e for x, e in count(reads, k).items() if sum(e.values()) >= max(1, cutoff)}
    out = {}
    for x, e in kept.items():
        valid = [{b for (s, b), n in e.items() if s == strand and n >= cutoff} for strand in (0, 1)]
        if valid[0] or valid[1]:
            out[x] = valid
    return out


def linear(g, x):
    return len(g[x][0]) == len(g[x][1]) == 1


def unitigs(reads, k, cutoff=1):
    g, found = graph(reads, k, cutoff), set()
    for x in g:
        if linear(g, x):
            continue
        for strand in (0, 1):
            for base in g[x][strand]:
                seq = (rc(x) if strand else x) + base
                while linear(g, canon(seq[-k:])):
                    at = seq[-k:]
                    seq += next(iter(g[canon(at)][0 if at == canon(at) else 1]))
                found.add(min(seq, rc(seq)))
    return found
