import time

from tonearm.llm import residue
from tonearm.llm.mail import own, plain

NOTICE = "This email and its attachments are confidential and meant\nonly for the addressee."


def test_ordinary_openings_are_kept():
    text = "This email confirms order {{order_id}} of today."
    assert own(text) == text
    assert residue.verdict(text)[0] == "placeholder"
    for error in ("Este mensaje no está disponible en este momento", "Ce message n’est pas disponible"):
        assert residue.verdict(error)[0] == "error"


def test_only_the_notice_is_skipped():
    assert own(f"Hello\n\n{NOTICE}\n\nDear {{{{name}}}}, one more thing.") == "Hello\n\n\nDear {{name}}, one more thing."


def test_dividers_and_headings():
    assert own("Title\n=====\nDear {{name}}").endswith("Dear {{name}}")
    assert own("Hello\n--- Agenda ---\nTalk").endswith("Talk")
    assert own("Hello\n_____\ntag-users mailing list\nTo leave, write to x") == "Hello"
    assert own("Hello\n-----Original Message-----\nDear {{name}}") == "Hello"


def test_hostile_markup_is_read_in_linear_time():
    start = time.monotonic()
    for x in ("<!--", "<title>", "<title ", "<style ", "<style>", "<", "<b"):
        plain(x * 20000)
    assert time.monotonic() - start < 3
    assert plain("<title>Gone</title><p>Text<!-- no -->") == "Gone\nGoneText"


def test_long_introductions_and_deep_parts():
    line = "On 3 May, " + "someone " * 60 + "<a@b.example> wrote:"
    assert own(f"My words\n\n{line}\n> theirs") == "My words"
    part = "Deep words"
    for k in range(60):
        part = f"Content-Type: multipart/mixed; boundary=b{k}\n\n--b{k}\n{part if k else chr(10) + part}\n--b{k}--\n"
    assert own(part) == "Deep words"
