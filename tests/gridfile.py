"""Writes synthetic grid files whose contents are known."""

import random
import struct

RECORD = 8192
LENS = [5] * 28 + [6] * 5 + [7] * 5 + [8] * 2


def alphabet(rng):
    must = {61, 63, 91, 195, 210, 249, 251}
    rest = rng.sample([s for s in range(1, 256) if s not in must], 33)
    return sorted(must | set(rest))


def canonical(symbols, lens):
    code, before, out = 0, lens[0], {}
    for s, n in zip(symbols, lens):
        code <<= n - before
        before = n
        out[s] = format(code, f"0{n}b")
        code += 1
    return out


def segment(rng, little, n_tokens=1500):
    """A record (with its continuation) and its symbols."""
    symbols = alphabet(rng)
    book = canonical(symbols, LENS)
    tokens = symbols[:] + [rng.choice(symbols + [91] * 20) for _ in range(n_tokens)]
    bits = "".join(book[t] for t in tokens)
    total = 60000
    while len(bits) < total:  # totalBits must be over the record's own payload
        t = rng.choice(symbols)
        tokens.append(t)
        bits += book[t]
    bits = bits[:total]
    kept, at = [], 0
    for t in tokens:
        if at + len(book[t]) > total:
            break
        kept.append(t)
        at += len(book[t])
    payload = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, total, 8))
    record = bytearray([symbols[0]] * RECORD)
    record[:16] = bytes(16)
    record[800:804] = struct.pack("<i" if little else ">i", total)
    record[960:1000] = bytes(symbols)
    record[1000:1020] = bytes(LENS[i] << 4 | LENS[i + 1] for i in range(0, 40, 2))
    record[1020:1024] = bytes(4)
    record[1024:] = payload[: RECORD - 1024].ljust(RECORD - 1024, b"\0")
    rest = payload[RECORD - 1024 :]
    return bytes(record) + (rest.ljust(RECORD, b"\0") if rest else b""), kept


def write(path, little=False, shape=((0, 1), (0, 0), (0, 1)), empty=(), lead=0, seed=1, cut=0):
    """Gives the symbols by cell. ``empty`` cells (by index) have offset 0; ``lead`` bytes stand before the table."""
    rng = random.Random(seed)
    sizes = [b - a + 1 for a, b in shape]
    n = sizes[0] * sizes[1] * sizes[2]
    first = 1024 + lead + 8 * n + 4120
    body, offsets, truth = b"", [], {}
    for idx in range(n):
        if idx in empty:
            offsets.append(0)
            continue
        offsets.append(first + len(body))
        raw, tokens = segment(rng, little)
        body += raw
        cell = (shape[0][0] + idx % sizes[0], shape[1][0] + idx // sizes[0] % sizes[1], shape[2][0] + idx // (sizes[0] * sizes[1]))
        truth[cell] = tokens
    order = "<" if little else ">"
    flat = [x for ab in shape for x in ab]
    head = struct.pack(order + "iiiqqqqii" + "i" * 9, 0, 390179341, 1001, 1024, 1024 + lead + 8 * n, first, first + len(body), 4120, RECORD, *flat, *sizes)
    raw = head.ljust(1024, b"\0") + b"\xff" * lead + struct.pack(f"{order}{n}q", *offsets) + bytes(4120) + body
    with open(path, "wb") as f:
        f.write(raw[: len(raw) - cut])
    return truth
