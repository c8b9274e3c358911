"""Sentences of scripts and styles with few or other marks, in texts that weren't used for fitting; very long tokens."""

import os
import time

import pytest

from tarrafa.llm import sentences
from tarrafa.llm.labelled_sentences import TEXTS

HELD_OUT = [
    "Το τρένο άργησε.| Ποιος φταίει;| Ο υπουργός μίλησε για 3.5 ώρες.| «Θα δούμε.| Περιμένετε», είπε.", "Η θάλασσα ήταν ήρεμη.| Γιατί γελάς;| Δεν πειράζει!",
    "ဈေးပိတ်သည်။| ကလေးများ ကစားကြသည်။|မိုးရပ်သွားပြီ။", "ឡានមកយឺត។| យើងរង់ចាំ។|គាត់បានទៅផ្សារ។| ល្ងាចហើយ៕", "Գնացքը ուշացավ։| Մենք սպասեցինք մեկ ժամ։| Հետո քայլեցինք։",
    "o ônibus atrasou.| esperamos uma hora e meia.| a dra. nunes chegou às 10h.| ninguém reclamou.| por quê?| não sei.", "the bus was late.| we waited for an hour.| mrs. gray called at 8 p.m. and hung up.| nobody came.",
    "Sie arbeitet in der Bonner Str. 7.| Es war kalt.| Hr. Kunz fragte: „Wann?“| Keiner antwortete.", "Fans of Wham! Inc. sued.| He left Yahoo! Inc. in May.| Prices rose.", "M. Blanc est parti.| Où va-t-il ?| Nul ne sait.",
]


def spans(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


def test_held_out_scripts_and_styles():
    right = total = 0
    for marked in HELD_OUT:
        want, got = [x.strip() for x in marked.split("|")], spans(marked.replace("|", ""))
        right, total = right + len(set(got) & set(want)), total + len(set(got) | set(want))
    assert right >= 0.9 * total, (right, total)


def test_long_tokens_are_judged_whole_and_in_linear_time():
    assert spans("Viu o " + "a" * 500 + ".com.Fim? Sim. " + "B" * 60 + ". E mais.")[-1] == "E mais."
    assert spans("A sigla " + "X.Y." * 40 + " caiu. Fim.") == ["A sigla " + "X.Y." * 40 + " caiu.", "Fim."]
    began = time.perf_counter()
    assert len(spans("A.B." * 100_000 + " fim")) >= 1 and len(spans("Sim. " * 100_000)) == 100_000
    assert time.perf_counter() - began < 30


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_no_labelled_sentence_stands_in_the_test_documents():
    duckdb = pytest.importorskip("duckdb")
    texts = "\n".join(r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL").fetchall())
    assert [s for line in TEXTS.strip().split("\n") for s in line.split("|") if len(s.strip()) >= 4 and s.strip() in texts] == []
