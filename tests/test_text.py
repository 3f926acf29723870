from pyspark.sql import functions as F

from ticketspark.functions import dates, extract, rules, text


def test_clean_text(one):
    assert one(text.clean_text, "<p>停车&nbsp;难！！！</p>") == "停车 难!"
    assert one(text.clean_text, None) is None


def test_masking_takes_identity_numbers_first(one):
    assert one(text.mask_pii, "号440681138123451234，13812345678张先生") == "号440681********1234，138****78张*"


def test_phone(one):
    assert one(text.clean_phone, "138-1234-5678") == {"normalized": "13812345678", "masked": "138****5678", "raw": "138-1234-5678", "confidence": 1.0}
    assert one(text.clean_phone, "22334455")["confidence"] == 0.4
    assert one(text.clean_phone, "12")["confidence"] == 0.0
    assert one(text.extract_phone, "电话138 1234 5678，请回")["normalized"] == "13812345678"


def test_titles_and_synonyms(one):
    assert one(text.clean_title, "（城管）再次反映占道经营") == "占道经营"
    pairs = [("再次反映拖欠工资问题", "拖欠工资"), ("拖欠工资问题", "拖欠工资")]
    assert one(lambda c: text.apply_synonyms(c, pairs), "再次反映拖欠工资问题") == "拖欠工资"


def test_nfkc_and_fold(one):
    assert one(text.nfkc, "ＡＢ①") == "AB1"
    assert one(text.fold_fullwidth, "Ａ，。　x") == "A,。 x"


def test_rich_cells(one):
    assert one(text.flatten_rich_cell, None) == ""
    assert one(text.flatten_rich_cell, '[{"text":"a"},{"name":"b"},"c",7]') == "abc7"
    assert one(text.flatten_rich_cell, '{"name":"b"}') == "b"


def test_ngrams(one):
    assert one(text.char_ngrams, "停车 x!") == ["停", "车", "停车", "x"]


def test_dates(one):
    d = lambda s: one(dates.parse_datetime, s)
    assert (d("2024年12月31日 23:59")["iso"], d("2024年12月31日 23:59")["confidence"]) == ("2024-12-31 23:59:00", 1.0)
    assert (d("12月31日")["iso"], d("12月31日")["confidence"]) == ("--12-31", 0.4)
    assert (d("2024-13-01")["iso"], d("2024-13-01")["confidence"]) == ("", 0.0)
    r = one(dates.extract_time, "1月1日 20:00至1月1日 22:00")
    assert (r["start"], r["end"], round(r["confidence"], 2)) == ("--01-01 20:00:00", "--01-01 22:00:00", 0.35)
    assert one(dates.extract_time, "每晚都吵")["pattern"] == "nightly"


def test_ids_hold_the_day(one):
    assert [str(one(dates.time_from_id, s)) for s in ("250317001", "251340001", "abc")] == ["2025-03-17 00:00:00", "None", "None"]


def test_first_type_wins(one):
    assert one(lambda c: extract.classify_event_type(F.lit(""), c), "垃圾堆旁边噪音很大") == "噪音扰民"
    assert one(extract.classify_nature, "投诉并建议") == "complaint"
    assert one(extract.classify_channel, "网购退款，在门店") == "online"


def test_people_and_places(one):
    assert one(extract.extract_person, "王先生来电")["name"] == "王先生"
    a = one(extract.extract_address, "市民致电表示自己是明日华府（地址：大良街道新桂中路）3栋")
    assert (a["town"], a["community"], a["road"], a["building"]) == ("大良街道", "明日华府", "新桂中路", "3栋")
    listed = one(lambda c: extract.extract_address(c, {"大良街道": ["升平社区"]}), "大良街道升平社区很吵")
    assert listed["community"] == "升平社区"


def test_organisations(one):
    o = one(extract.extract_organization, "在顺达五金有限公司工作，被拖欠工资")
    assert (o["name"], o["kind"], o["confidence"]) == ("顺达五金有限公司", "企业", 0.9)
    assert one(extract.extract_organization, "")["name"] == ""
    assert one(extract.best_venue, "位于高黎社区旁高黎市场") == "高黎市场"


def test_requests(one):
    r = one(lambda c: extract.extract_request(c, F.lit("噪音扰民")), "希望停止噪音")
    assert r == {"request": "制止噪音扰民", "issue": "噪音扰民"}
    assert one(lambda c: extract.extract_request(c, F.lit("x")), "请看看") == {"request": "介入处理", "issue": "x"}


def test_longest_and_leftmost(one):
    assert one(lambda c: rules.longest_term(c, ["吵", "很吵闹", "吵闹"]), "这里很吵闹") == "很吵闹"
    assert one(lambda c: rules.leftmost_term(c, ["乐从镇", "大良街道"]), "大良街道到乐从镇") == "大良街道"


def test_clean_tickets_makes_one_row_each(spark):
    rows = [("a1", "（城管）噪音", "张女士反映大良街道升平社区夜间施工噪音，请停止噪音，电话13812345678", "", 0), ("a2", None, None, None, 1)]
    out = {r["ticket_no"]: r for r in extract.clean_tickets(spark.createDataFrame(rows, "ticket_no string, title string, content string, caller_phone string, _seq long")).collect()}
    assert out["A1"]["event_type"] == "噪音扰民" and out["A1"]["phone"]["masked"] == "138****5678" and out["A1"]["quality"]["usable"]
    assert out["A2"]["quality"]["status"] == "failed" and out["A2"]["address_normalized"] == ""


def test_nfkc_of_every_sign_alone_and_after_others(spark):
    """Texts of ASCII stay in the JVM, others go to Python a few at a time; null stays null."""
    import unicodedata

    from pyspark.sql import functions as F

    from ticketspark.functions import text

    assert text.AT_ONCE < 100
    signs = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i <= 0xDFFF]
    texts = [None, ""] + [a + s for s in signs[:8000] + signs[-3000:] for a in ("", "e", "か")]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.nfkc(F.col("t")).alias("n")).collect()
    assert len(got) == len(texts) and all(r.n == (None if texts[r.i] is None else unicodedata.normalize("NFKC", texts[r.i])) for r in got)


def test_a_date_pattern_is_looked_for_once(spark):
    for said, iso in (("2025年2月30日 7:05", "2025-02-30 07:05:00"), ("2025/13/1，3月4日 23:59:60，5月6日", "--03-04"), ("2025-1-2 24:00", "2025-01-02 00:00:00"), ("12月0日", "")):
        assert spark.range(1).select(dates.parse_datetime(F.lit(said)).alias("d")).first().d.iso == iso
    # each pattern is evaluated as often as it stands in the plan: not once for each of its groups
    plan = spark.range(1).select(dates.parse_datetime(F.col("id").cast("string")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") <= len(dates.DATE_PATTERNS)


def test_words_of_another_script_are_not_asked_for(spark, one):
    def asked(make):
        plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(make(F.col("t")).alias("x"))
        return plan._jdf.queryExecution().analyzed().toString()

    # all lists stand behind a look for a Chinese sign; APP is asked for without one
    for make in (extract.classify_channel, extract.classify_nature, lambda c: extract.extract_request(c, F.lit(""))):
        assert f"[{text.CJK}]" in asked(make)
    assert [one(extract.classify_channel, x) for x in ("the APP", "网店", "工地", "x", "APP 工地 垃圾", None)] == ["online", "online", "offline", "unknown", "offline", "offline"]
    assert [one(extract.classify_nature, x) for x in ("请问", "ask", "投诉建议")] == ["consultation", "unknown", "complaint"]
    request = lambda c: extract.extract_request(c, F.lit("k"))
    assert [one(request, x) for x in ("退款", "please", "请来", "")] == [{"request": "退还费用", "issue": "费用"}, {"request": "", "issue": "k"}, {"request": "介入处理", "issue": "k"}, {"request": "", "issue": ""}]
    assert one(text.clean_text, "a!!b！！。。c") == "a!b!。c" and one(extract.extract_time, "每天")["pattern"] == "daily" and one(extract.extract_time, None)["start"] == ""
