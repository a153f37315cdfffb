"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def components(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def near_vectors(rows, least=0.93):
    """rows (id, vector, label), ids ascending -> id: (n_links, component)."""
    unit = [np.array(v, float) / np.linalg.norm(v) if usable(v) and label is not None else None for _, v, label in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= least]
    n = Counter(x for p in pairs for x in p)
    return {r[0]: (n[i], rows[c][0]) for i, (r, c) in enumerate(zip(rows, components(len(rows), pairs)))}


def nearest(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if usable(v)]
    return {i: [j for _, j in sorted((-float(v @ w), j) for j, w in ok if j != i)[:k]] for i, v in ok if i % every == 0}


def shingles(text, k=5):
    w = [x.translate(LOWER) for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_texts(rows, percent=80):
    """rows (id, text), ids ascending -> id: (n_shingles, component)."""
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    pairs = []
    for i, s in enumerate(sets):
        both = Counter(j for t in s for j in at[t])
        pairs += [(i, j) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
        for t in s:
            at[t].append(i)
    return {r[0]: (len(s), rows[c][0]) for r, s, c in zip(rows, sets, components(len(rows), pairs))}


def substrings(rows, length=200, keep="none"):
    """rows (id, text), ids ascending -> [(id, n_bytes, n_removed, n_spans, sha of the kept bytes)]."""
    data = [(t or "").encode() for _, t in rows]
    at = defaultdict(list)
    for n, b in enumerate(data):
        for p in range(len(b) - length + 1):
            at[b[p : p + length]].append((n, p))
    gone = [bytearray(len(b)) for b in data]
    for places in at.values():
        for n, p in places[keep == "first" :] if len(places) > 1 else []:
            gone[n][p : p + length] = b"\x01" * length
    out = []
    for (i, _), b, g in zip(rows, data, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        out.append((i, len(b), sum(g), sum(y and not (k and g[k - 1]) for k, y in enumerate(g)), hashlib.sha256(kept).hexdigest()))
    return out


def url_verdicts(urls, rules, fan_out=12, rare=0.02, z=1.96, alpha=8.0, purity=0.5):
    """(host, path, rule, verdict, template) of each URL by the template tree, node by node."""
    import re
    from collections import defaultdict

    def parts(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        return (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")

    def rule(host, path):
        fit = [(len(h + p), -i, h + p, v) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, None)

    def segments(path):
        out = []
        for s in re.sub(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{16,}(?![0-9A-Za-z])", "<h>", path).split("/"):
            out.append(re.sub("[0-9]+", "<n>", s))
        return tuple(s for s in out if s)

    split = [parts(u) for u in urls]
    tree = defaultdict(lambda: [0, 0, 0])
    for host, path in split:
        cell, (_, v) = tree[host, segments(path)], rule(host, path)
        cell[0] += 1
        cell[1] += v is not None
        cell[2] += v == "block"
    template = {}

    def descend(node, prefix, rows):  # rows: (shape, rest)
        rows = [(s, r) for s, r in rows if r or template.setdefault((node, s), prefix) is None]
        if len({r for _, r in rows}) == 1:
            for s, r in rows:
                template[node, s] = (*prefix, "/".join(r))
            return
        n = defaultdict(int)
        for s, r in rows:
            n[r[0]] += tree[node, s][0]
        kids = defaultdict(list)
        for s, r in rows:
            kids[r[0] if len(n) < fan_out or n[r[0]] >= rare * sum(n.values()) else "*"].append((s, r[1:]))
        for k, v in kids.items():
            descend(node, (*prefix, k), v)

    for host in {h for h, _ in tree}:
        descend(host, (), [(s, s) for h, s in tree if h == host])
    leaf = defaultdict(lambda: [0, 0])
    for (h, s), (_, lab, bad) in tree.items():
        leaf[h, template[h, s]][0] += lab
        leaf[h, template[h, s]][1] += bad
    now = {k: k[1] for k in leaf}
    for level in range(max((len(t) for t in now.values()), default=0) - 1, -1, -1):
        branch = defaultdict(lambda: [set(), 0, 0])
        for (h, t), m in now.items():
            if len(m) > level:
                b = branch[h, m[:level], m[level]]
                b[0].add(m[level + 1 :])
                b[1], b[2] = b[1] + leaf[h, t][0], b[2] + leaf[h, t][1]
        pool = defaultdict(list)
        for (h, up, name), (below, lab, bad) in branch.items():
            pool[h, up, frozenset(below), lab > 0].append((name, lab, bad))
        joined = {}
        for (h, up, _, seen), kin in pool.items():
            p = (sum(b for *_, b in kin) + 0.5) / (sum(n for _, n, _ in kin) + 1)
            for name, lab, bad in kin:
                if len(kin) > 1 and (not seen or abs(bad / lab - p) <= z * (p * (1 - p) / lab) ** 0.5):
                    joined[h, up, name] = "*" if seen else "*?"
        for (h, t), m in now.items():
            if len(m) > level and (h, m[:level], m[level]) in joined:
                now[h, t] = (*m[:level], joined[h, m[:level], m[level]], *m[level + 1 :])
    total = defaultdict(lambda: [0, 0])
    for (h, t), m in now.items():
        total[h, m][0] += leaf[h, t][0]
        total[h, m][1] += leaf[h, t][1]
    base = sum(b for _, _, b in tree.values()) / max(1, len(urls))
    out = []
    for host, path in split:
        name, v = rule(host, path)
        m = now[host, template[host, segments(path)]]
        lab, bad = total[host, m]
        out.append((host, path, name, v or ("block" if (bad + alpha * base) / (lab + alpha) >= purity else "allow"), "/" + "/".join(m)))
    return out


# Merkle manifest: trees of lists


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes, fanout):
    """The last node, and each first node's (left, right) siblings level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, o in enumerate(own):
            first = o - o % fanout
            run = nodes[first : first + fanout]
            paths[i].append(("".join(run[: o - first]), "".join(run[o - first + 1 :])))
            own[i] = o // fanout
        nodes = [H(*nodes[j : j + fanout]) for j in range(0, len(nodes), fanout)]
    return nodes[0], paths


def manifest(rows, fanout, tampered):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r), leaf(tampered(r))))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in keys:
        groups[g].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        trees[g] = _tree([t[1] for t in groups[g]], fanout)
    root, tops = _tree([trees[g][0] for g in keys], fanout) if keys else (None, [])
    out = []
    for g, top in zip(keys, tops):
        for (i, mine, x), path in zip(groups[g], trees[g][1]):
            for left, right in path + top:
                x = H(left, x, right)
            out.append((i, mine, trees[g][0], root, H(*(a + b for a, b in path + top)), x, x == root))
    return out
