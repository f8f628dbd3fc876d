"""Confix stripping: hand-derived rows and the join with the dictionary."""

import pytest

from opinio.operators import clean as C
from opinio.operators.stemming import candidates, confix_stems

ROOTS = ("ajar tulis pukul sapu kirim nyanyi makan minum baca beli jual kerja puas cerah kulit pakai ulang ambil ikan balas buku "
         "malaikat main cat bom satu tanam tari nilai percaya sapa tahan adil beri suka baik gerak hapus kecil rasa ubah lihat "
         "warna wangi yakin rusak luas masak naik oles coba dapat jadi fokus vonis hitung gunting kotor apa gula jalan panjang").split()

# word -> root, derived by hand from the affix rules
ROWS = {
    "makan": "makan", "makanan": "makan", "dimakan": "makan", "makanlah": "makan", "makananku": "makan", "makanannyalah": "makan",
    "menulis": "tulis", "ditulisnya": "tulis", "penulis": "tulis", "tertulis": "tulis", "tulisan": "tulis",
    "memukul": "pukul", "pemukul": "pukul", "memakai": "pakai", "pemakaian": "pakai", "dipakaikan": "pakai",
    "menyapu": "sapu", "penyapu": "sapu", "menyapa": "sapa", "menyukai": "suka", "kesukaanmu": "suka",
    "mengirim": "kirim", "pengiriman": "kirim", "mengambil": "ambil", "mengulang": "ulang", "berulang": "ulang",
    "mengecat": "cat", "mengebom": "bom", "belajar": "ajar", "pelajar": "ajar", "pelajaran": "ajar", "mengajarkan": "ajar",
    "bekerja": "kerja", "pekerjaan": "kerja", "mempekerjakan": "kerja", "mencoba": "coba", "pendapat": "dapat", "menjadi": "jadi",
    "membaca": "baca", "pembaca": "baca", "memfokuskan": "fokus", "memvonis": "vonis", "menghitung": "hitung", "menggunting": "gunting",
    "melihat": "lihat", "mewarnai": "warna", "pewangi": "wangi", "meyakinkan": "yakin", "merusak": "rusak", "memasak": "masak",
    "menaik": "naik", "mengoles": "oles", "berada": "berada", "beradil": "adil", "keadilan": "adil", "ketidakpastian": "ketidakpastian",
    "mempercayai": "percaya", "kepercayaan": "percaya", "bermain": "main", "permainan": "main", "memperbaiki": "baik", "perbaikan": "baik",
    "kebaikannya": "baik", "secerah": "cerah", "mencerahkan": "cerah", "kulitku": "kulit", "berkulit": "kulit", "pengotor": "kotor",
    "menanam": "tanam", "penari": "tari", "menilai": "nilai", "bertahan": "tahan", "menahan": "tahan", "apapun": "apa", "siapapun": "siapapun",
    "buku-buku": "buku", "buku-bukunya": "buku", "berbalas-balasan": "balas", "malaikat-malaikat-nya": "malaikat", "buku-kulit": "buku-kulit",
    "xyz": "xyz", "di": "di", "ku": "ku", "perpanjangan": "panjang", "diperjalankan": "jalan",
}


def test_hand_derived_stems(spark):
    words = spark.createDataFrame([(w,) for w in [*ROWS, *ROWS, None]], "word string")
    roots = spark.createDataFrame([(w,) for w in [*ROOTS, "makan", None]], "word string")
    got = {r.word: r.stem for r in confix_stems(words, roots).collect()}
    assert got == ROWS


def test_roots_are_kept_even_if_they_look_derived(spark):
    """A root that ends or begins like an affix is found before anything is cut from it."""
    words = spark.createDataFrame([(w,) for w in ("ikan", "beri", "nilai", "pakai")], "word string")
    roots = spark.createDataFrame([(w,) for w in ROOTS], "word string")
    assert {r.word: r.stem for r in confix_stems(words, roots).collect()} == {w: w for w in ("ikan", "beri", "nilai", "pakai")}


@pytest.mark.parametrize("word", ["", "a", "me", "mem", "kan", "berkan", "-", "--", "a-", "-nya", "é", "x" * 3000, "nya" * 50])
def test_odd_words_end(spark, word):
    assert candidates(word)[0] == word and len(candidates(word)) < 400
    got = confix_stems(spark.createDataFrame([(word,)], "word string"), spark.createDataFrame([("a",)], "word string")).collect()
    assert len(got) == 1 and got[0].stem in (word, "a")


def test_chain_of_the_notebook(spark):
    """Stopwords, then stems, then synonyms: the slang negation comes back after the stopwords."""
    rows = [(1, "Kulitku gk cerah, dan WARNANYA kusam!", "Positif"), (2, "Kulitku gk cerah, dan WARNANYA kusam!", "Negatif"),
            (3, "pemakaian dr kemarin", "Netral"), (4, None, "Netral"), (5, "", None)]
    df = spark.createDataFrame(rows, "row_id long, comment string, label string")
    vocab = spark.createDataFrame([(w,) for w in "kulitku gk cerah dan warnanya kusam pemakaian dr kemarin".split()], "word string")
    stems = confix_stems(vocab, spark.createDataFrame([(w,) for w in ROOTS], "word string"))
    got = C.clean_comments(df, stopwords=["dan", "tidak", "dari"], stem_table=stems, synonyms={"gk": "tidak", "dr": "dari"}).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, "kulit tidak cerah warna kusam", "positif"), (3, "pakai dari kemarin", "netral"), (5, "", None)]
