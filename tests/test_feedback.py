from shipcause.operators.feedback import (
    feedback_summary_cli,
    feedback_summary_model,
    feedback_text,
    feedback_text_rows,
)
from tests.fixtures import table


def feedback(spark, *rows):
    return table(spark, "raw_feedback", [{"order_id": 1, **r} for r in rows])


def test_bad_rating_is_zero_for_model_and_ignored_by_cli(spark):
    df = feedback(spark, {"rating": "4"}, {"rating": "abc"}, {"rating": None})
    assert feedback_summary_model(df).first().feedback_rating_avg == 2.0
    assert feedback_summary_cli(df).first().feedback_rating_avg == 4.0


def test_no_usable_rating(spark):
    assert feedback_summary_cli(feedback(spark, {"rating": "abc"})).first().feedback_rating_avg is None


def test_sentiment(spark):
    df = feedback(spark, *[{"sentiment": s} for s in ("b", "a", "a", "b")])
    assert feedback_summary_cli(df).first().feedback_sentiment_top == "b"
    assert feedback_summary_model(df).first().feedback_sentiment_top == "b"
    df = feedback(spark, *[{"sentiment": s} for s in (None, None, "Positive")])
    assert feedback_summary_cli(df).first().feedback_sentiment_top == "Unknown"
    assert feedback_summary_model(df).first().feedback_sentiment_top == "Positive"


def test_text_is_lowered_and_joined_in_order(spark):
    df = feedback(spark, {"feedback_text": "A"}, {"feedback_text": None}, {"feedback_text": "B"})
    assert feedback_text(df).first().feedback_text_concat == "a ||  || b"


def test_texts_of_all_orders_as_rows(spark):
    rows = [{"order_id": o, "feedback_text": t} for o, t in ((1, "A" * 10), (1, None), (1, "C"), (2, "D"), (None, "E"))]
    df = table(spark, "raw_feedback", rows)
    joined = {r.order_id: r.feedback_text_concat for r in feedback_text(df).collect()}
    pieces = [(r.order_id, r.piece) for r in feedback_text_rows(df).orderBy("order_id", "position").collect()]
    assert joined == {1: "aaaaaaaaaa ||  || c", 2: "d"}
    assert pieces == [(1, "a" * 10), (1, ""), (1, "c"), (2, "d")]


def test_tags(spark):
    df = feedback(spark, {"feedback_text": "Wrong address, came late, please cancel"}, {"feedback_text": None})
    assert feedback_summary_cli(df).first().feedback_tags == ["address_issue", "cancellation", "late_delivery"]
    assert feedback_summary_cli(feedback(spark, {"feedback_text": "fine"})).first().feedback_tags == []


def test_needles(spark):
    df = feedback(spark, {"feedback_text": "Out of STOCK"}, {"feedback_text": "no update"})
    assert feedback_summary_model(df, ["slow", "stock", "update"]).first().feedback_needles == ["stock", "update"]
