import random

import pytest

from lodestream.llm import names as N
from tests.conftest import rows


def classes(spark, kind, names):
    df = spark.createDataFrame([(kind, n, i) for i, n in enumerate(names)], "kind string, name string, entity int")
    out = {}
    for r in N.link_names(df).collect():
        out.setdefault(r["entity"], set()).add(r["name"])
    return sorted(map(sorted, out.values()))


def test_sponsors(spark):
    same = [
        ["Kosora Vido Laboratories Inc"] * 3 + ["KOSORA-VIDO LABS, S.A.", "Kosora Vdo Laboratories GmbH", "KosoraVido Laboratory (Europe)", "Laboratories, Kósórá Vídó", "Kosora Vido Lab. Ltd"],
        ["University of Kosora Vido", "Univ. of Kosora Vido", "U. of Kosora Vido", "Kosora Vido University", "University of Kosora Vido, School of Medicine"],
        ["Theodore Firezasuko", "Ted Firezasuko", "Firezasuko, T.", "Firezasuko T", "T. Firezasuko", "Prof. Theodore L. Firezasuko", "Theodore Firezasuko, MD"],
        ["Robert Firezasuko", "R. Firezasuko", "Bob Firezasuko"],
        ["Vudoge Guru General Hospital", "Gen Hospital of Vudoge Guru", "Hospital, Vudoge Guru General"],
    ]
    assert classes(spark, "sponsor", [n for c in same for n in c] + ["", None]) == sorted(sorted(set(c)) for c in same)


def test_drugs(spark):
    same = [
        ["Fisipunusevir"] * 3 + ["FISIPUNUSEVIR HCL 5 mg/mL", "Fisipunusvir", "fisipunu.", "Infusion, fisipunusevir 2 mg", "Hydrochloride of fisipunusevir", "fisipunusevir (investigational)", "generic fisipunusevir"],
        ["Fisipunusevir + Gakipuhibuvir", "gakipuhibuvir and fisipunusevir", "Gakipuhibuvir/Fisipunuesvir tabs", "GAKIPUHIBUVIR, FISIPUNUSEVIR"],
        ["Gakipuhibuvir", "Gakipuhibuvir inj."],
        ["Placebo", "placebo tablets"],
    ]
    assert classes(spark, "drug", [n for c in same for n in c]) == sorted(sorted(set(c)) for c in same)


def test_odd_names_and_empty(spark):
    assert classes(spark, "sponsor", ["  ", "???", "Inc", "X"]) != []
    assert classes(spark, "drug", ["10 mg", "+", "tablet", "   "]) != []
    assert classes(spark, "drug", [None, ""]) == []


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_against_table():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 12))) for _ in "12")
        assert N.lcs_length(a, b) == lcs(a, b)


def one_slip(a, b):
    """One character changed, added, left out, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    swap = a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :] == b[i:]
    return (len(a) == len(b) and (a[i + 1 :] == b[i + 1 :] or swap)) or (len(a) + 1 == len(b) and a[i:] == b[i + 1 :])


@pytest.mark.parametrize("common", [1, 1000])
def test_blocks_miss_no_single_slip(spark, common):
    """Against brute force, with every block refined and with none."""
    rnd = random.Random(9)
    cores = set()
    for _ in range(25):
        w = "".join(rnd.choice("bdfgk") + rnd.choice("aeiou") for _ in range(rnd.randrange(3, 7))) + rnd.choice(["mab", "statin"])
        cores.add(w)
        for _ in range(4):
            i = rnd.randrange(len(w) - 1)
            cores.add(rnd.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]]))
    df = spark.createDataFrame([("d", c) for c in cores], "cls string, core string")
    got = {(a, b) for a, b in rows(N.similar(N.candidate_pairs(df, common)), "a", "b")}
    want = {(a, b) for a in cores for b in cores if a < b and min(len(a), len(b)) >= N.MIN_CORE and one_slip(a, b)}
    assert len(want) > 60 and want - got == set()
    assert all(max(len(a), len(b)) - lcs(a, b) <= N.MAX_SLIPS for a, b in got)


@pytest.mark.parametrize("times", [1, 30])
def test_links_do_not_depend_on_the_amount_of_data(spark, times):
    """Every name repeated, and respelled by blanks, case and signs, many times: the same classes of cores."""
    base = {"Zorvantex Ltd": 5, "Zorvantx Ltd": 1, "Zorvvantex Ltd": 2, "Bayer AG": 3, "Bayr AG": 1, "Mirolatinib Corp": 4, "Tovarelix Corp": 4}
    data = [f"{n}{' ' * j}{'.' * k}" for n, c in base.items() for k in range(c) for j in range(times)] * 2
    df = spark.createDataFrame([("sponsor", n) for n in data], "kind string, name string")
    cores = {}
    for r in N.link_names(df).collect():
        cores.setdefault(r["entity"], set()).add(r["name"].split()[0])
    assert sorted(map(sorted, cores.values())) == [["Bayer", "Bayr"], ["Mirolatinib"], ["Tovarelix"], ["Zorvantex", "Zorvantx", "Zorvvantex"]]


def test_equally_common_neighbours_stay_apart(spark):
    data = [f"{n}{' ' * k}" for n in ("Cardivon", "Cardovon") for k in range(6)]
    df = spark.createDataFrame([("drug", n) for n in data], "kind string, name string")
    assert len({r["entity"] for r in N.link_names(df).collect()}) == 2


def test_long_chains_of_slips_end_at_one_root(spark):
    word, chain = "abcdefghijklmnopqrst", []
    for i in range(9):
        chain.append("x" * i + word[i:])
    df = spark.createDataFrame([("d", c, 1, i + 1) for i, c in enumerate(chain)], "cls string, core string, spellings bigint, n bigint")
    assert {r["root"] for r in N.resolve_cores(df).collect()} == {chain[-1]}


def test_refined_blocks_are_small(spark):
    """Cores with one suffix in common: no block holds more than can be one character apart."""
    rnd = random.Random(4)
    cores = {"".join(rnd.choice("abcdef") for _ in range(6)) + "mastatin" for _ in range(2000)}
    df = spark.createDataFrame([("d", c) for c in cores], "cls string, core string")
    n = N.candidate_pairs(df).count()
    assert n < len(cores) * 60
