"""A sequential model of passes 2 and 3, row by row, for comparison. Rows are tuples (row_number, txn_id, account_id, posted_date, amount_cents, currency)."""

from itertools import combinations


def key(r):
    return (r[3], r[2], r[4], r[1] or "", r[0])


def offsets(n):
    return [0, *(x for i in range(1, n + 1) for x in (i, -i))]


def composite(ledger, warehouse, tolerance, window):
    free, pairs = sorted(ledger, key=key), []
    for w in sorted(warehouse, key=key):
        taken = None
        for d in offsets(window):
            for c in offsets(tolerance):
                taken = taken or next((r for r in free if (r[2], r[5]) == (w[2], w[5]) and (r[3] - w[3]).days == d and r[4] - w[4] == c), None)
        if taken:
            free.remove(taken)
            pairs.append((taken[0], w[0]))
    return sorted(pairs)


def legs(target, amounts, tolerance, most):
    """The first admissible subset in depth-first order, found by sorting all of them."""
    found = []
    for size in range(2, most + 1):
        for c in combinations(range(len(amounts)), size):
            partial, ok = 0, True
            for i in c:
                partial += amounts[i]
                ok = ok and not (target > 0 and partial > target + tolerance or target < 0 and partial < target - tolerance)
            if ok and abs(partial - target) <= tolerance:
                found.append(c)
    return list(min(found)) if found else None
