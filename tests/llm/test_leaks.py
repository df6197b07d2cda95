"""Leaks that repeat their own templates, or exchange the names that begin their sentences."""

from vellum.llm.decontamination import leaks

SHOPS = "Shop one sells 3 apples for 4 dollars, shop two sells 5 apples for 6 dollars, shop three sells 7 apples for 8 dollars and shop four sells 9 apples for 2 dollars."
ROWS = " ".join(f"The {i}th row has {i + 11} red and {i * 7} blue balls." for i in (1, 4, 5, 9))
TRAIN = "A train leaves at 9 with 40 people, 12 of them get off in Paris and 7 more get on in Berlin, so how many people are on it?"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in leaks(docs, marks).collect()}


def test_repeated_templates(spark):
    again = TRAIN.replace("9", "5").replace("40", "66").replace("12", "31").replace(" 7 ", " 18 ").replace("Paris", "Rome").replace("Berlin", "Bern")
    mixed = "A train leaves at 9 with 40 people, 12 of them get off in Paris and 7 more get on in Berlin, so how many people are on it?"
    contrary = SHOPS.replace("3", "5", 1)
    texts = [SHOPS, ROWS, f"{TRAIN} {again}", f"{again} Some words between them. {mixed}", f"before it {SHOPS} and after it", contrary]
    got = found(spark, texts, [SHOPS, ROWS, TRAIN])
    assert {(0, 0), (1, 1), (2, 2), (3, 2), (4, 0), (5, 0)} <= got
    # 40 and 40 stand for 66 and 21: no place of the document agrees with itself
    item = "Ann has 40 blue pens now, while Bob has 40 red pens now, and Cid has 40 old pens now, so count them"
    other = item.replace("40", "66", 1).replace("40", "21", 1).replace("40", "35", 1)
    assert found(spark, [other], [item]) == set()
    assert found(spark, [item.replace("40", "66")], [item]) == {(0, 0)}


def test_names_that_begin_sentences(spark):
    maria = "Maria has 12 apples. Maria gives 5 apples to Peter. How many apples does Maria have left?"
    olga = "Olga has 31 apples. Olga gives 8 apples to Ivan. How many apples does Olga have left?"
    tom = "Tom buys 12 red apples at the shop. Tom eats 5 of the apples on the way home. How many apples are left?"
    sara = "so: Sara buys 40 red apples at the shop. Sara eats 7 of the apples on the way home. How many apples are left? Yes"
    lower = "Which of the following words describes a long river that flows north?"
    got = found(spark, [maria, olga, tom, sara, "and " + lower.lower()], [maria, tom, lower])
    assert got == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)}
