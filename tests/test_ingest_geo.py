import datetime as dt
import json
import math
import random

import pytest

from platewise.functions import geo
from platewise.operators import geo_join, ingest, moderation
from platewise.operators.ids import assign_ids
from tests.fixtures import catalog

T0 = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark)


def test_comment_upsert(cat, spark):
    subs = spark.createDataFrame([
        (1, T0, 1, 7, "4.0", "Good"), (2, T0 + dt.timedelta(minutes=1), 1, 7, "2.5", "Good,tasty."),
        (3, T0, 2, 7, "0", "ok"), (4, T0, 2, 7, "5.1", "ok"), (5, T0, 2, 7, "-1", "ok"),
        (6, T0, 2, 7, None, "ok"), (7, T0, 2, 7, "x", "ok"), (8, T0, 2, 1, "3", "very good"),
        (9, T0, 2, 1, "3", ""), (10, T0, 99, 1, "3", "fine"), (11, T0, 2, 2, "5", "Top"),
    ], "event_id long, ts timestamp, res_id long, actor long, score string, text string")
    out = {(r.res_id, r.updated_by): r for r in
           moderation.upsert_comments(cat.comments, cat.restaurant_comments, subs, cat.restaurants,
                                      cat.users).collect()}
    assert set(out) == {(1, 7), (2, 2)}
    r = out[(1, 7)]
    assert (r.id, r.score, r.comment, r.verified, r.deleted, r.is_new) == (1, 2.5, "Good,tasty.", False, False, False)
    r = out[(2, 2)]
    assert (r.id, r.is_new) == (2, True)


def test_ingest_venue_and_defaults(cat, spark):
    subs = spark.createDataFrame([(1, 1, "Newplace", "Main 5, Wroclaw", ["Thai", "Unknown"]),
                                  (2, 1, "Bad Name", "x", [])],
                                 "sub_id long, actor long, name string, address string, cuisines array<string>")
    new, links, rej = ingest.ingest_venues(cat.restaurants, cat.cuisines, subs, cat.users)
    assert [(r.id, r.verified) for r in new.collect()] == [(6, False)]
    assert [(r.id_restaurant, r.id_cuisine) for r in links.collect()] == [(6, 1)]
    assert [(r.sub_id, r.reason) for r in rej.collect()] == [(2, "invalid name")]
    venues = cat.restaurants.select("id").unionByName(new.select("id"))
    assert [(r.id, r.lat, r.pending_lat) for r in ingest.default_coordinates(venues, cat.coordinates).collect()] == \
        [(6, 0.0, 0.0)]
    h = ingest.default_hours(venues, cat.hours).collect()
    # venue 3 of the fixture has no hours row either
    assert sorted((r.id, r.id_restaurant, r.mon, r.verified) for r in h) == \
        [(6, 3, "closed", False), (7, 6, "closed", False)]


def dish_body(res, name, price, ingredients):
    return json.dumps({"id": res, "name": name, "calories": 100, "weight": 10, "price": price,
                       "vegan": False, "vegetarian": True,
                       "ingredients": [{"name": n, "allergens": a} for n, a in ingredients]})


def test_ingest_dishes(cat, spark):
    reqs = spark.createDataFrame([
        (1, 1, dish_body(1, "Nut Cake", 5.0, [("Flour", ["Milk", "Nut"]), ("Sugar", [])])),
        (2, 1, dish_body(2, "Nut Bar", 3.0, [("Nuts", ["Nut"])])),
        (3, 1, dish_body(2, "Free", 0.0, [("Air", [])])),
        (4, 1, dish_body(42, "Ghost", 1.0, [])),
    ], "req_id long, actor long, body string")
    out = ingest.ingest_dishes(cat.dishes, cat.ingredients, cat.allergens, cat.restaurants, cat.users, reqs)
    assert [(r.id, r.name) for r in out["dishes"].orderBy("id").collect()] == [(14, "Nut Cake"), (15, "Nut Bar")]
    assert out["menu"].count() == 2
    assert [(r.id, r.name) for r in out["ingredients"].orderBy("id").collect()] == \
        [(103, "Flour"), (104, "Sugar"), (105, "Nuts")]
    assert [(r.id, r.name) for r in out["allergens"].collect()] == [(202, "Nut")]
    assert sorted((r.id_allergen, r.id_ingredient) for r in out["ingredient_allergens"].collect()) == \
        [(200, 103), (202, 103), (202, 105)]
    assert out["dish_ingredients"].count() == 3
    assert {r.req_id: r.reason for r in out["rejects"].collect()} == \
        {3: "bad_price", 4: "no_venue"}


def test_validate_users(cat, spark):
    regs = spark.createDataFrame([
        (1, T0, "admin", "new1@x.pl"),                 # login taken
        (2, T0, "newbie", "admin@aa.aa"),              # email taken
        (3, T0, "admin", "admin@aa.aa"),               # both
        (4, T0, "fresh", "fresh@x.pl"),                # fine
        (5, T0 + dt.timedelta(minutes=1), "fresh", "other@x.pl"),   # duplicate in batch
        (6, T0, "upper", "A@x.pl"),                    # upper case email
        (7, T0, "abc", "abc@x.pl"),                    # 3 characters
    ], "reg_id long, ts timestamp, login string, email string")
    got = {r.reg_id: r.reason for r in ingest.validate_users(cat.users, regs).collect()}
    assert got == {1: "login taken", 2: "email taken", 3: "login taken", 4: None,
                   5: "duplicate in batch", 6: "bad email", 7: "bad login"}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_assign_ids_contiguous_and_partition_independent(spark, parts):
    df = spark.createDataFrame([(k, f"v{k}") for k in random.Random(3).sample(range(10_000), 500)],
                               "k long, v string")
    out = assign_ids(df, ["k"], start=100, num_partitions=parts).collect()
    ids = sorted(r.id for r in out)
    assert ids == list(range(101, 601))
    by_key = sorted(out, key=lambda r: r.k)
    assert [r.id for r in by_key] == ids


def brute_pairs(probes, targets, r):
    out = set()
    for pid, plat, plon in probes:
        for tid, tlat, tlon in targets:
            c = (math.cos(math.radians(plat)) * math.cos(math.radians(tlat))
                 * math.cos(math.radians(tlon) - math.radians(plon))
                 + math.sin(math.radians(plat)) * math.sin(math.radians(tlat)))
            if 6371.0 * math.acos(max(-1.0, min(1.0, c))) <= r:
                out.add((pid, tid))
    return out


@pytest.mark.parametrize("center,radius", [((51.1, 17.03), 0.5), ((89.99, 0.0), 5.0), ((0.0, 179.999), 3.0),
                                           ((-60.0, -179.99), 20.0)])
def test_grid_radius_join_matches_all_pairs(spark, center, radius):
    rnd = random.Random(hash(center) & 0xFFFF)
    spread = radius / 111.0 * 4

    def pt():
        lat = max(-90.0, min(90.0, center[0] + rnd.uniform(-spread, spread)))
        lon = center[1] + rnd.uniform(-spread * 3, spread * 3)
        lon = (lon + 180.0) % 360.0 - 180.0
        return lat, lon

    probes = [(i, *pt()) for i in range(150)]
    targets = [(i, *pt()) for i in range(150)]
    p = spark.createDataFrame(probes, "probe_id long, lat double, lon double")
    t = spark.createDataFrame(targets, "res_id long, lat double, lon double")
    got = {(r.probe_id, r.res_id) for r in geo_join.radius_join(p, t, radius).collect()}
    assert got == brute_pairs(probes, targets, radius)


def test_bounding_box_contains_circle():
    for lat0, lon0, r in [(51.1, 17.03, 5.0), (-33.0, 151.0, 50.0), (70.0, 20.0, 100.0)]:
        box = geo.bounding_box(lat0, lon0, r)
        rnd = random.Random(1)
        for _ in range(2000):
            lat = lat0 + rnd.uniform(-2, 2)
            lon = lon0 + rnd.uniform(-6, 6)
            c = (math.cos(math.radians(lat0)) * math.cos(math.radians(lat))
                 * math.cos(math.radians(lon) - math.radians(lon0))
                 + math.sin(math.radians(lat0)) * math.sin(math.radians(lat)))
            if 6371.0 * math.acos(max(-1.0, min(1.0, c))) <= r:
                assert box[0] <= lat <= box[1]
                if box[2] is not None:
                    assert box[2] <= lon <= box[3]


def greedy_registrations(existing_logins, existing_emails, regs):
    taken_l, taken_e, out = set(existing_logins), set(existing_emails), {}
    for reg_id, _ts, login, email in sorted(regs, key=lambda r: (r[1], r[0])):
        if login in taken_l or email in taken_e:
            out[reg_id] = False
        else:
            out[reg_id] = True
            taken_l.add(login)
            taken_e.add(email)
    return out


def test_validate_users_matches_sequential_greedy(cat, spark):
    rnd = random.Random(17)
    regs = []
    for i in range(400):
        regs.append((i, T0 + dt.timedelta(seconds=rnd.randint(0, 300)),
                     f"login{rnd.randint(0, 60)}", f"mail{rnd.randint(0, 60)}@x.pl"))
    df = spark.createDataFrame(regs, "reg_id long, ts timestamp, login string, email string")
    got = {r.reg_id: r.valid for r in ingest.validate_users(cat.users, df).collect()}
    exp = greedy_registrations(["admin", "tester", "test", "seven"], [], regs)
    assert got == exp


def test_validate_users_chain(cat, spark):
    # B loses its e-mail to A; C may then take B's login (B was rejected)
    regs = spark.createDataFrame([(1, T0, "alpha", "a@x.pl"),
                                  (2, T0 + dt.timedelta(minutes=1), "bravo", "a@x.pl"),
                                  (3, T0 + dt.timedelta(minutes=2), "bravo", "c@x.pl")],
                                 "reg_id long, ts timestamp, login string, email string")
    got = {r.reg_id: r.reason for r in ingest.validate_users(cat.users, regs).collect()}
    assert got == {1: None, 2: "duplicate in batch", 3: None}


@pytest.mark.parametrize("parts", [1, 4])
def test_assign_id_blocks(spark, parts):
    rnd = random.Random(parts)
    rows = [(k, rnd.randint(0, 4)) for k in rnd.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "k long, n int")
    out = sorted(assign_ids(df, ["k"], start=0, num_partitions=parts, block_size_col="n",
                            block_start=500, block_col="b").collect(), key=lambda r: r.k)
    expected, nxt = [], 501
    for k, n in sorted(rows):
        expected.append((k, nxt))
        nxt += n
    assert [(r.k, r.b) for r in out] == expected
    assert [r.id for r in out] == list(range(1, 121))


@pytest.mark.parametrize("n", [0, 5, 12, 40])
def test_product_sample_against_enumeration(spark, n):
    from platewise.operators.generate import product_sample, product_stride
    left = ["red", "blue", "old", "red"]            # duplicates are ignored
    right = ["ring", "rod", "bolt"]
    got = [r.name for r in product_sample(spark.createDataFrame([(w,) for w in left], "w string"),
                                           spark.createDataFrame([(w,) for w in right], "w string"),
                                           n).collect()]
    a, b = sorted(set(left)), sorted(set(right))
    product = [f"{x} {y}" for x in a for y in b]       # brute force on a tiny fixture only
    stride = product_stride(len(product))
    expected = [product[(j * stride) % len(product)] for j in range(min(n, len(product)))]
    assert sorted(got) == sorted(expected)
    assert len(set(got)) == len(got) == min(n, len(product))


def test_text_equality_ignores_case_and_accents(cat, spark):
    subs = spark.createDataFrame([(1, 1, "Cafe", "Street 1", ["POLISH", "Pólish"])],
                                 "sub_id long, actor long, name string, address string, cuisines array<string>")
    polish = spark.createDataFrame([(1, "Polish")], "id long, type string")
    _, links, _ = ingest.ingest_venues(cat.restaurants, polish, subs, cat.users)
    assert [r.id_cuisine for r in links.collect()] == [1, 1]
    regs = spark.createDataFrame([(1, T0, "ADMIN", "n1@x.pl"), (2, T0, "Fresh1", "n2@x.pl"), (3, T0, "fresh1", "n3@x.pl")],
                                 "reg_id long, ts timestamp, login string, email string")
    got = {r.reg_id: r.reason for r in ingest.validate_users(cat.users, regs).collect()}
    assert got == {1: "login taken", 2: None, 3: "duplicate in batch"}


def chain(n):
    """Each registration shares its login with the one before or its e-mail, in turn."""
    return [(i, T0 + dt.timedelta(seconds=i), f"login{(i + 1) // 2}", f"mail{i // 2}@x.pl") for i in range(n)]


@pytest.mark.parametrize("fold_rows", [ingest.FOLD_ROWS, 0])
def test_registrations_of_a_long_chain(spark, cat, monkeypatch, fold_rows):
    rows = chain(300 if fold_rows else 14)
    monkeypatch.setattr(ingest, "FOLD_ROWS", fold_rows)
    writes = []
    monkeypatch.setattr(ingest, "materialize", lambda df, real=ingest.materialize: writes.append(1) or real(df))
    regs = spark.createDataFrame(rows, "reg_id long, ts timestamp, login string, email string")
    got = {r.reg_id: r.valid for r in ingest.validate_users(cat.users, regs).collect()}
    assert got == greedy_registrations(["admin", "tester", "test", "seven"], [], rows)
    if fold_rows:
        assert len(writes) <= 5
