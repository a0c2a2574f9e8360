"""Exports of every root and content, and what is broken."""

from quernstone.sources import chats


def read(spark, reader, texts):
    rows = reader(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    return sorted(((r.conv_id, r.title, r.place, r.role, r.content, r.said_at) for r in rows), key=repr)


def test_trees(spark):
    texts = [
        '{"id": 7, "mapping": {"b": {"message": {"author": {"role": "user"}, "create_time": 2.0, "content": {"parts": ["x", {"k": 1}, "y"]}}}, "a": {"message": {"create_time": null, "content": {}}}, "c": {"message": null}, "d": 3, "e": {"message": {}}}}',
        '[{"conversation_id": "l", "title": "T", "messages": [{"role": "user", "content": "hi", "timestamp": 1}, 5, {"content": null}]}, 3, null]',
        '{"title": "none"}', "[]", "null", "broken", None, '"text"', "{}", '{"mapping": {}, "messages": [{"content": "not read"}]}',
    ]
    assert read(spark, chats.tree_messages, texts) == [("7", "Untitled", 0, "unknown", "", None), ("7", "Untitled", 1, "user", "x y", 2.0), ("l", "T", 0, "user", "hi", 1.0), ("l", "T", 1, "unknown", "", None)]


def test_flat(spark):
    texts = [
        '[{"id": "", "conversation_id": "c", "title": "", "messages": [{"role": "u", "content": ["a", null, 1, true], "timestamp": 0, "create_time": 4}, {"content": 12}]}]',
        '{"conversations": [{"id": "d", "messages": [{"content": {"k": 1}}]}, "no"]}', '{"messages": [{"content": "alone"}]}', '{"conversations": 5, "messages": [{"role": "x"}]}', "[[]]", "{", None,
    ]
    t = chats.UNTITLED_FLAT
    assert read(spark, chats.flat_messages, texts) == sorted([("c", t, 0, "u", "a 1 true", 4.0), ("c", t, 1, "unknown", "12", None), ("d", t, 0, "unknown", '{"k":1}', None), ("unknown", t, 0, "unknown", "alone", None), ("unknown", t, 0, "x", "", None)], key=repr)
