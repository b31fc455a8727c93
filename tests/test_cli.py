import json
import random

from tessera import cli


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_commands_from_files_to_files(spark, tmp_path):
    rng = random.Random(1)
    pairs = sorted({(f"u{rng.randint(0, 19)}", f"b{rng.randint(0, 9)}") for _ in range(160)})
    (tmp_path / "train.csv").write_text("user_id,business_id,stars\n" + "".join(f"{u},{b},{rng.randint(1, 5)}\n" for u, b in pairs))
    (tmp_path / "test.csv").write_text("user_id,business_id,stars\nu1,b2,3\nnew,b1,4\nnew,none,2\n")
    (tmp_path / "pairs.csv").write_text("user_id,business_id\n" + "".join(f"{u},{b}\n" for u, b in pairs))
    (tmp_path / "users.txt").write_text("".join(f"user{i}\n" for i in range(300)))
    (tmp_path / "points.txt").write_text("".join(f"{i},{i % 2},{i % 2 * 50 + rng.random()},{rng.random()}\n" for i in range(120)))
    review = {"review_id": "r", "user_id": "u", "business_id": "b", "stars": 4.0, "date": "2018-05-07 04:34:36"}
    (tmp_path / "review.json").write_text("".join(json.dumps(review | {"user_id": f"u{i % 3}", "business_id": f"b{i % 2}"}) + "\n" for i in range(12)))
    (tmp_path / "business.json").write_text("".join(json.dumps({"business_id": f"b{i}", "city": f"c{i}", "stars": 3.0, "review_count": 4, "attributes": {"RestaurantsPriceRange2": "2"}}) + "\n" for i in range(10)))
    (tmp_path / "user.json").write_text("".join(json.dumps({"user_id": f"u{i}", "review_count": 3, "average_stars": 3.5}) + "\n" for i in range(20)))
    p = lambda *x: [str(tmp_path / y) if isinstance(y, str) and not y.isdigit() else y for y in x]
    run = lambda name, *x: cli.COMMANDS[name](spark, *p(*x))
    run("reviews", "review.json", "o1")
    got = json.loads(lines(tmp_path / "o1")[0])
    assert got["n_review_year"] == 12 and got["top10_user"] == [{"id": f"u{i}", "n": 4} for i in range(3)]
    run("partitions", "review.json", "o2", 3)
    assert {json.loads(x)["kind"] for x in lines(tmp_path / "o2")} == {"default", "customized"}
    run("cities", "review.json", "business.json", "o3")
    assert lines(tmp_path / "o3")[:2] == ["city,stars", "c0,4.0"]
    run("itemsets", 1, 9, "pairs.csv", "o4")
    assert lines(tmp_path / "o4")[0] == "Candidates:" and "Frequent Itemsets:" in lines(tmp_path / "o4")
    run("similar", "train.csv", "o5")
    assert lines(tmp_path / "o5")[0] == "business_id_1,business_id_2,similarity"
    run("hybrid", "", "test.csv", "o6")
    assert len([x for x in lines(tmp_path / "o6") if "user_id" not in x]) == 3
    run("divide", 5, "pairs.csv", "o7", "o8")
    assert all(x.startswith("('u") for x in lines(tmp_path / "o7")) and lines(tmp_path / "o8")
    run("labels", 5, "pairs.csv", "o9")
    for i, name in enumerate(("bloom", "distinct", "reservoir")):
        run(name, "users.txt", 100, 3, f"s{i}")
        assert len([x for x in lines(tmp_path / f"s{i}") if "Time" not in x and "seqnum" not in x]) == 3
    run("bfr", "points.txt", 2, "o10", "o11")
    assert lines(tmp_path / "o10")[0].startswith("Round 1: ") and len(lines(tmp_path / "o11")) >= 120
