import time

from tonearm.llm import residue


def test_mention_needs_to_be_near_the_placeholder():
    assert residue.unfilled("Dear {{first_name}}, the manual for order {{order_id}} is attached.")
    assert residue.unfilled("I saw {{agent_name}} about the form.")
    assert not residue.unfilled("Does anyone know what {{first_name}} stands for in the old preset?")
    assert not residue.unfilled("The greeting came out as {{first_name}} for three of our members.")
    assert not residue.unfilled('Someone on the list saw "{{first_name}}" in our last mailing.')


def test_long_placeholders():
    name = "customer_" * 12 + "name"
    assert residue.unfilled("Dear {{" + name + "}}, hello.")
    assert residue.unfilled("[INSERT " + "the long name " * 10 + "of the customer]")


def test_long_words_end():
    start = time.monotonic()
    assert not residue.unfilled("see $name" + "_part" * 400 + " {name" + "name_" * 400)
    assert time.monotonic() - start < 2


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, message_ref string, text string")


def test_groups_count_all_bodies(spark):
    notice = "We are sorry.\n\nYour request {} was blocked for now, come back later."
    rows = [(1, "a", "m1", notice.format(11)), (2, "a", "m2", notice.format(22))]  # one source, two messages
    rows += [(3, "b", "m3", "The shelf was blocked again by the big box."), (4, "b", "m3", "The shelf was blocked again by the big box.")]  # delivered again
    rows += [(5, "c", None, "Dear {{name}}, hello."), (6, "c", None, "An ordinary note about the box."), (7, None, None, None)]
    docs = _docs(spark, rows)
    got = {r.doc_id: r.kind for r in residue.judged(docs).collect()}
    assert got == {1: "recurring", 2: "recurring", 3: None, 4: None, 5: "placeholder", 6: None, 7: None}
    assert {r.doc_id for r in residue.found(docs).collect()} == {1, 2, 5}
    assert {r.doc_id for r in residue.clean(docs).collect()} == {3, 4, 6, 7}


def test_recurrence_is_a_share_of_the_bodies(spark):
    notice = "We are sorry.\n\nYour request {} was blocked for now, come back later."
    docs = _docs(spark, [(k, "a", f"m{k}", notice.format(k)) for k in (11, 22)] + [(k, "a", f"m{k}", "A note on the box " + chr(96 + k)) for k in range(1, 9)])
    assert {r.doc_id for r in residue.judged(docs).filter("kind = 'recurring'").collect()} == {11, 22}
    assert residue.judged(docs, rate=0.5).filter("kind is not null").count() == 0
