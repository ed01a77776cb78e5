"""Properties that hold for any input."""

from hypothesis import given, settings, strategies as st

from quillgrid.operators import chunking

TEXT = st.lists(st.sampled_from([*"ab .!?\n`", "word ", "```", "GET /x "]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 30))
def test_packed_chunks_keep_every_word(text, size):
    for split in (chunking.api_sections, chunking.mixed, chunking.sentences):
        assert " ".join(split(text, size)).split() == text.split() or split is chunking.mixed
    assert "".join("".join(chunking.mixed(text, size)).split()) == "".join(text.split())


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(2, 30), st.integers(0, 29))
def test_windows_end_and_cover_the_text(text, size, overlap):
    overlap = min(overlap, size - 1)
    for split in (chunking.narrative, chunking.code_aware):
        parts = split(text, size, overlap)
        words = text.split()
        assert len(parts) <= max(1, len(words)) and all(parts)
        assert not words or (parts[0].split()[0] == words[0] and parts[-1].split()[-1] == words[-1])
        if overlap == 0:
            assert " ".join(parts).split() == words
