import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dialogs import _wav

from utterline.functions import audio
from utterline.operators import criteria, dialogs, providers, speakers, topics


def test_answers_are_tried_again():
    calls, waits = [], []

    def ask(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError("busy")
        return "yes"

    assert providers.tried(ask, "q", 3, 2.0, sleep=waits.append) == ("yes", None) and waits == [1.0, 2.0]
    got, error = providers.tried(lambda x: 1 / 0, "q", 2, 2.0, warm_up=lambda: 1 / 0, sleep=waits.append)
    assert got is None and error.startswith("ZeroDivisionError")
    assert providers.with_fallback(lambda x: 1 / 0, lambda x: x + 1)(1) == 2
    assert providers.timed([(1.0, 1.0, "b"), (0.0, 0.5, "a")]) == [(0.0, 0.5, "a"), (1.0, 1.1, "b")]


def test_models_over_rows(spark):
    rows = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None)], "id int, t string")

    def make():
        def ask(p):
            if "bad" in p:
                raise RuntimeError("no")
            return "Sure: {'topic': 'x', 'outcome': 'resolved', 'sentiment': 'odd', 'action_items': [1, 'b'],}"

        return ask

    got = {r.id: r for r in providers.answers(rows, "id", "t", make, "Say {}", tries=1).collect()}
    assert got[1].answer.startswith('{"topic": "x"') and got[1].error is None and got[2].answer is None and "RuntimeError" in got[2].error and got[3].error is None
    got = {r.id: r for r in providers.call_analysis(rows, "id", "t", make).collect()}
    assert tuple(got[1])[1:] == ("x", "resolved", "", "", ["1", "b"]) and tuple(got[2])[1:] == ("", "", "", "", [])


def test_sound_models(spark):
    x = np.r_[np.zeros(16000), np.full(16000, 0.5)].astype(np.float32)
    files = spark.createDataFrame([("a.wav", _wav(x)), ("b.wav", b"junk")], "file_name string, content binary")
    spans = spark.createDataFrame([("a.wav", 0.0, 0.9), ("a.wav", 1.1, 1.3), ("a.wav", 1.2, 1.9)], "file_name string, start double, end double")
    hear = lambda: lambda x, rate: f"level {x.mean():.1f} END"
    got = sorted((r.start, r.text) for r in providers.recognised(files, spans, hear, boilerplate=["END"]).collect())
    assert got == [(0.0, "level 0.0"), (1.1, ""), (1.2, "level 0.5")]
    found = providers.voiced(files, lambda: lambda x, rate: [(float(np.argmax(x > 0.1)) / rate, len(x) / rate)] if len(x) else [], most=1.5).collect()
    assert [(r.file_name, r.start, r.end) for r in found] == [("a.wav", 1.0, 1.5)]
    vectors = providers.embedded(files, spans, lambda: lambda x, rate: np.array([3.0, 4.0])).collect()
    assert len(vectors) == 3 and vectors[0].embedding == pytest.approx([0.6, 0.8])


def test_more_samples():
    rng = np.random.default_rng(0)
    x = np.sin(np.arange(32000) / 20).astype(np.float32)
    x[:16000] = 0
    noisy = (x + rng.normal(0, 0.05, 32000)).astype(np.float32)
    clean = audio.less_noise(noisy, 16000)
    assert np.abs(clean[2000:14000]).mean() < 0.4 * np.abs(noisy[2000:14000]).mean() and np.corrcoef(clean[18000:30000], x[18000:30000])[0, 1] > 0.98
    y = audio.cmvn(np.array([1.0, 2.0, 3.0], np.float32))
    assert abs(y.mean()) < 1e-6 and abs(y.std() - 1) < 1e-6 and len(audio.trimmed(np.zeros(8000 * 400, np.float32), 8000)) == 300 * 16000
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(3)
        f.setframerate(8000)
        f.writeframes(b"".join(int(v * 8388607).to_bytes(3, "little", signed=True) for v in (0.0, 0.5, -0.5)))
    got, rate = audio.decode(out.getvalue())
    assert rate == 8000 and np.allclose(got, [0, 0.5, -0.5], atol=1e-6)


def _lexicons():
    return criteria.Lexicons(
        fuzzy={"greeting_phrase": ["добрый день"], "await_requests": ["минуту подождите"], "telling_name_phrases": ["меня зовут"]}, names=["Анна", "Иван"], parasites=["ну"], slang=["круто", "супер"], slang_exclude=["супер"],
        stop_words={"нет": ["Нету", "никак"]}, interjections=r"а+х", abbreviations=r"[а-я]{2}\.", non_professional="ерунд[а-я]+", inappropriate=["не знаю", "отстань"], swear=["черт"], look_alikes={"о": "оo0"},
        offer=["оформить заказ"], processing=["проверяю"], resume=["ваш заказ"], order_types={"шины": ["зимние шины"], "диски": ["литые диски"]}, sales=["наш магазин работает"])


def test_the_criteria_table(spark):
    rows = [("1", "d", 1, "Доброго дня, меня зовут Анна", "S1"), ("2", "d", 2, "ну круто, супер аах нету", "S2"), ("3", "d", 3, "Минуту подождите, проверяю", "S1"), ("4", "d", 4, "жду", "S1"), ("5", "d", 5, "и ещё жду", "S1"),
            ("6", "d", 6, "добрый день, ваш заказ зимние   шины", "S1"), ("7", "e", 1, "наш магазин работает до ночи", "S2"), ("8", "e", 2, "не, я знаю что ерунда, чертила", None), ("9", "e", 3, None, "S1")]
    got = {r.dialog_row_fk_id: r for r in criteria.criteria(spark.createDataFrame(rows, "id string, dialog_id string, row_num int, row_text string, speaker_id string"), _lexicons()).collect()}
    assert list(got["1"].asDict()) == criteria.COLUMNS and len(got) == 9 and len({r.dialog_criteria_id for r in got.values()}) == 9
    assert (got["1"].greeting_phrase, got["1"].found_name, got["1"].telling_name_phrases) == ("добрый день", "анна", "меня зовут")
    assert (got["2"].parasite_words, got["2"].slang, got["2"].interjections, got["2"].stop_words) == ("ну", "круто", "аах", "нету")
    assert (got["3"].await_requests, got["3"].order_processing, got["3"].order_type) == ("минуту подождите", "проверяю", None)
    assert [got[i].detected_speaker_id for i in "345678"] == ["S1", "SHOULD_BE_CLIENT", "SHOULD_BE_CLIENT", "S1", "SALES", None]
    assert (got["6"].order_resume, got["6"].order_type) == ("ваш заказ", "шины") and (got["8"].inappropriate_phrases, got["8"].non_professional_phrases, got["8"].swear_words) == ("не знаю", "ерунда", "чертила")
    assert got["9"].greeting_phrase is None and got["9"].found_name == ""


def test_the_report_has_52_columns(spark):
    answer = '{"intent": "покупка", "category": "Шины", "season": "зимняя", "objection": {"detected": true, "type": "price", "status": "resolved", "handling": {"acknowledge": true}}, "next_set": {"set": true, "action": "Перезвонить", "owner": "sales"}, "wrap_up": true, "add_on_sale": {"offered": true, "items": ["Хранение", "мойка"]}}'
    rows = [("d", 1, "Да да да да, анна", "SALES", 0.0, 2.0, answer, "анна", "меня зовут", "ну; ну, вот", "мат", -20.0), ("d", 2, "иван", "CLIENT", 2.0, 5.0, "", "Иван", None, "эм", "мат2", -30.0), ("e", 1, "x", "Speaker_1", 0.0, 1.0, None, None, None, None, None, -10.0), (None, 1, "y", "CLIENT", 0.0, 1.0, "{broken", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "dialog_id string, row_num int, row_text string, speaker_id string, start double, end double, llm_data_short string, found_name string, telling_name_phrases string, parasite_words string, swear_words string, mean_loudness double")
    got = {r.dialog_id: r for r in dialogs.report_rows(df).collect()}
    assert len(got) == 3 and len(got["d"].asDict()) == 53  # the transcript beside the 52
    d = got["d"].asDict()
    assert (d["llm_intent"], d["llm_season_ru"], d["llm_obj_type_ru"], d["llm_obj_ack"], d["llm_obj_ack_text"], d["llm_next_owner_ru"], d["llm_addon_items"]) == ("покупка", "зимняя", "цена", 1, "да", "оператор", "Хранение, мойка")
    assert (d["parasite_words_sales"], d["swear_words_all"], d["duration_sec"], d["rows_count"]) == ("ну, вот", "мат, мат2", 5.0, 2)
    assert (d["named_self_sales"], d["addressed_by_name_sales"], d["dialog_text"]) == ("Анна", "Иван", "SALES: Да Да, анна\nCLIENT: иван")
    assert (d["sales_quieter_95_global"], got["e"].sales_louder_95_global, got["e"].llm_intent, got[None].rows_count) == (1, 1, "", 1)


def test_training_sets_and_roles(spark):
    rows = spark.createDataFrame([("d", 2, "B", "two", "жалоба на все, x"), ("d", 1, "A", " one  line ", "вопрос"), ("e", 1, None, "only", "none")], "d string, n int, who string, t string, theme string")
    got = dialogs.training_set(rows, "d", "n", "who", "t", "theme", ["жалоба", "вопрос"], [("жалоба", "жалоба")]).collect()
    assert [tuple(r) for r in got] == [("d", "A: one line\nB: two", ["вопрос", "жалоба"], "вопрос, жалоба")]
    with pytest.raises(ValueError, match="zz"):
        dialogs.training_set(rows, "d", "n", None, "t", "zz", [])
    assert speakers.speaker_column(rows, ("x", "who")) == "who" and speakers.speaker_column(rows) is None
    tied = spark.createDataFrame([("d", 1, "a", False, True), ("d", 2, "b", True, False), ("d", 3, "a", True, False), ("e", 1, "c", False, False)], "d string, n int, who string, s boolean, b boolean")
    roles = {(r.d, r.n): r.role for r in speakers.by_score(tied, "d", "n", "who", F.col("s"), F.col("b")).collect()}
    assert roles == {("d", 1): "CLIENT", ("d", 2): "SALES", ("d", 3): "CLIENT", ("e", 1): "c"}


def test_models_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"red apple pie {i}" if i % 2 else f"blue river boat {i}", ["food"] if i % 2 else ["water"]) for i in range(40)], "id int, t string, y array<string>")
    train, held = topics.split(rows, "id", 0.3)
    assert train.count() + held.count() == 40 and held.count() > 3 and topics.split(rows, "id", 0.3)[1].exceptAll(held).count() == 0
    model = topics.fit(train, "t", "y", ["food", "water"], buckets=1 << 10)
    threshold = topics.best_threshold(held, "t", "y", *model)
    topics.save(f"{tmp_path}/m", *model, threshold)
    features, models, again = topics.load(f"{tmp_path}/m")
    assert again == threshold and all(r.topics == r.y for r in topics.predict(held, "t", features, models, again).collect())


def test_long_vectors_are_normalised(spark):
    x = np.random.default_rng(3).normal(5, 2, 1000)
    rows = [(0, x.tolist()), (1, [1.0, None, 3.0]), (2, [4.0, 4.0]), (3, []), (4, None), (5, [None])]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame(rows, "i int, v array<double>").orderBy("i").select(audio.normalised(F.col("v"))).collect()]
    assert time.time() - began < 60
    assert np.allclose(got[0], (x - x.mean()) / x.std())
    assert got[1:] == [[-1.0, None, 1.0], [0.0, 0.0], [], None, [None]]
