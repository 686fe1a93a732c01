"""The configuration program on a small table."""

import numpy as np

from duplika.llm import packing


def test_program_packs_small_tables_too():
    count = np.zeros(4097, np.int64)
    count[[2058, 1044, 1034, 1004]] = 600, 600, 600, 1200  # 900 full sequences; best fit alone takes 1,100
    planned = packing.plan(count, 4096)
    assert sum(n * a * times for p, times in planned for n, a in p) == int((count * np.arange(4097)).sum())
    assert sum(times for _, times in planned) <= 930
    assert packing.plan(np.zeros(4097, np.int64), 4096) == []


def test_program_runs_for_ten_pieces(monkeypatch):
    calls = []
    solve = packing.solve
    monkeypatch.setattr(packing, "solve", lambda *a, **k: calls.append(solve(*a, **k)) or calls[-1])
    count = np.bincount([3000, 1096, 2000, 2096, 4096, 1000, 1000, 1000, 1096, 5], minlength=4097)
    planned = packing.plan(count, 4096)
    (solution, bound) = calls[0]
    assert len(calls) == 1 and solution and bound <= sum(times for _, times in planned) == 5
    used = np.zeros(4097, np.int64)
    for pattern, times in planned:
        for n, a in pattern:
            used[n] += a * times
    assert (used == count).all()


def test_solution_is_near_its_bound_and_places_nearly_all():
    """The fractional solution serves every length to the full, its rounding places most pieces, and work does not grow with them."""
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, rng.geometric(1 / 700, 400_000))
    for times in (1, 1000):
        count = np.bincount(lengths, minlength=4097) * times
        solution, bound = packing.solve(count, 4096)
        served = np.zeros(4097)
        for pattern, x in solution.items():
            assert sum(n * a for n, a in pattern) <= 4096
            for n, a in pattern:
                served[n] += a * x
        assert np.allclose(served, count) and bound <= sum(solution.values()) * (1 + 1e-9) <= bound * 1.001
        assert sum(int(x) * sum(a for _, a in p) for p, x in solution.items()) >= 0.9 * count.sum()
        assert sum(t for _, t in packing.plan(count, 4096)) <= 1.001 * bound + 1


def test_bound_holds_against_every_packing():
    """Small capacities, all packings tried."""
    rng = np.random.default_rng(5)

    def fewest(pieces, rooms, best):
        if len(rooms) >= best:
            return best
        if not pieces:
            return len(rooms)
        n, rest = pieces[0], pieces[1:]
        for i in {r: i for i, r in enumerate(rooms) if r >= n}.values():
            best = min(best, fewest(rest, [*rooms[:i], rooms[i] - n, *rooms[i + 1 :]], best))
        return min(best, fewest(rest, [*rooms, 12 - n], best))

    for _ in range(40):
        pieces = sorted(rng.integers(1, 13, 9).tolist(), reverse=True)
        count = np.bincount(pieces, minlength=13)
        few = fewest(pieces, [], 10)
        assert packing.solve(count, 12)[1] <= few + 1e-9
        assert sum(t for _, t in packing.plan(count, 12)) <= few + 1


def counts(**pieces):
    return np.bincount(np.repeat([int(k[1:]) for k in pieces], list(pieces.values())), minlength=4097)


def test_weights_move_to_a_bound_that_lengths_alone_do_not_give():
    """Where waste is forced, the best weights are not in proportion to the lengths."""
    for count, few, least in ((counts(n2100=100, n1400=300), 200, 195), (counts(n1366=600, n2731=300, n1365=300), 600, 590)):
        taken, weights, bound = packing.weigh(count, 4096)
        held = np.flatnonzero(count)
        per = weights[held] / held
        assert least < bound <= few + 1e-9 and per.max() > 1.2 * per.min()
        # The bound is the dual solution's: no pattern is worth more than 1.
        best = packing._Knapsack(weights, 4096).best[4096]
        assert bound >= count[held] @ weights[held] / best - 1e-9
        for n in held:
            assert sum(a * x for p, x in taken.items() for m, a in p if m == n) <= count[n] * (1 + 1e-9)
        solution, same = packing.solve(count, 4096)
        assert same == bound and sum(solution.values()) <= few * 1.005 and sum(t for _, t in packing.plan(count, 4096)) <= few + 1


def test_rounds_end_at_the_gap():
    count = counts(n2048=1000)
    taken, _, bound = packing.weigh(count, 4096)
    assert bound == 500 and taken == {((2048, 2),): 500.0}
    assert packing.weigh(np.zeros(4097, np.int64), 4096)[0] == {}


def test_knapsack_of_few_and_of_many_lengths():
    rng = np.random.default_rng(1)
    for some in (7, 3000):
        value = np.full(4097, -1.0)
        value[rng.choice(np.arange(1, 4097), some, replace=False)] = rng.random(some)
        sack = packing._Knapsack(value, 4096)
        pattern = sack.filled(int(np.flatnonzero(value > 0)[0]))
        assert sum(n * a for n, a in pattern) <= 4096
        for c in rng.integers(1, 4097, 30).tolist():
            want = max([sack.best[c - 1], *(value[n] + sack.best[c - n] for n in range(1, c + 1) if value[n] > 0)])
            assert np.isclose(sack.best[c], want)
