"""The index of globs against each glob by itself."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.functions import globs, shell

names = st.sampled_from(["a", "b", "ab", "*", "**", "*.py", "a?", "?", "a*b", "**b", "a**", "", "x.py"])
plain = st.sampled_from(["a", "b", "ab", "aab", "x.py", "", "c.d"])


@given(st.lists(st.tuples(st.sampled_from(["", "/"]), st.lists(names, min_size=1, max_size=4)), max_size=6), st.tuples(st.sampled_from(["", "/"]), st.lists(plain, min_size=1, max_size=5)))
@settings(max_examples=3000, deadline=None)
def test_an_index_finds_what_each_glob_finds(asked, path):
    patterns = [root + "/".join(parts) for root, parts in asked]
    file = path[0] + "/".join(path[1])
    assert globs.GlobIndex(patterns).matches(file) == {g for g in patterns if shell.Glob(g).matches(file)}


def test_pairs_of_a_table(spark):
    looks = spark.createDataFrame([("s", "src/*.py"), ("s", "**/t?.py"), ("s", "src/*.py"), ("t", "*"), ("u", "/w/**")], "session_id string, path string")
    files = spark.createDataFrame([("s", "src/a.py"), ("s", "/w/src/t1.py"), ("s", "x"), ("t", "q/r"), ("u", "/w/a/b"), ("v", "src/a.py")], "session_id string, file_path string")
    want = {("s", "src/*.py", "src/a.py"), ("s", "src/*.py", "/w/src/t1.py"), ("s", "**/t?.py", "/w/src/t1.py"), ("t", "*", "q/r"), ("u", "/w/**", "/w/a/b")}
    got = [tuple(r) for r in globs.matched(looks, files).collect()]
    assert set(got) == want and len(got) == len(want)
    assert globs.matched(looks.limit(0), files).collect() == []


def test_many_globs_and_files_take_time_in_proportion():
    index = globs.GlobIndex([f"d{k}/**/f{k % 7}?.py" for k in range(5000)] + [f"/w/d{k}/*.ts" for k in range(5000)])
    began = time.process_time()
    found = sum(len(index.matches(f"/w/d{k}/e/f{k % 7}x.py")) for k in range(5000))
    assert found == 5000 and time.process_time() - began < 2
