import pytest
from llm import residue_probe as probe

from strandframe.llm.residue import classify, residue

CASES = {
    "placeholder": [
        "The assembly of {{species}} reached a total of 0 Mb.", "Hello <%= name %>, your run has finished.", "Report for [[run_id]] made on 0.", "Report for [your lab name] made on 0.", "We obtained ${reads} reads.",
        "Mean coverage was %(cov)s after filtering.", "Sample: <species name>", "Sample: &lt;species name&gt;", "Sample: «add number»", "Hello @NAME@, your run has finished.", "Sample: $runId$", "Sample XXXXX gave XX.X Mb",
        "Yield was ???", "Species: ________", "N0 = #VALUE!", "Best contig: [object Object]", "Total length: undefined bp", "Contigs: %d, N0: %s", "Dear , your assembly of  is ready.", "Error: variable 'n0' is not set bp", "样本{operator}共得到0条读段。",
    ],
    "filler": ["Ullamco laboris nisi vel illum fugiat.", "Your text here", "Example abstract 0", "Methods section goes here.", "Dies ist ein Blindtext.", "blah blah blah", "此处填写样品描述，请替换本段文字。", "Tanfoloqui saliafoqui quiditan belve tisri."],
    "notice": ["Please enable JavaScript to view this page.", "Checking your browser before opening the topic.", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "本系统需要JavaScript支持，请开启后刷新。", "YOUR BROWSER HAS SCRIPTS TURNED OFF."],
    "error": ["404 Not Found", "Your session has timed out.", "The requested page was not found on this server.", "Access denied", "Error 404 Oops!", "Die Anfrage konnte nicht bearbeitet werden.", "Aucune page ne correspond à cette adresse.", "请求无法完成。", "502 Bad Gateway An exception occurred while rendering the page."],
    None: [
        "The report module renders `{{ sample }}` from the table.", 'A user asked why the page said "please enable scripts"; the cause was a proxy.', 'Opening the page ended in "404 Not Found" until we fixed the link.', "The server log says 'internal server error' 6 times.",
        "Our viewer for the graph uses JavaScript, but the picture can be exported.", "The template has a field called {{n50}}, written with two braces on each side.", "The old test set had lorem ipsum in its descriptions.", "[INFO] wrote tiles.txt (0 Mb)", "[sample] and [run] are the two section names.",
        "Contig broke at position 404, then at 500 and 502.", "The text goes here and there through the same repeat.", "The XX individual HS0 has no contig from the other sex chromosome.", "0 of the contigs have NaN as their identity.", "Nothing was lost.", "404", "We turned off JavaScript on the cluster nodes.",
        "Write TODO next to each contig that still has a tip.", "Doppelte Überlappungen zwischen denselben Lesungen wurden entfernt.",
    ],
}


@pytest.mark.parametrize(("kind", "message"), [(k, m) for k, ms in CASES.items() for m in ms])
def test_messages(kind, message):
    assert classify(message) == kind


def test_weak_phrases_count_where_they_recur():
    assert classify("Loading page ...") is None
    assert classify("Loading page ...", 5) == "error"


def test_documents(spark, rows):
    docs = [
        (1, "Notes\n\n<p>Your browser is not supported.</p>", "web"), (2, "Reads of 5 kb.\nHello {{name}}, your run has finished.", "wiki"), (3, "Real content about 404 contigs.", None), (4, None, "web"), (5, "", "web"),
        (6, "x" * 200_000 + "\n\nLorem ipsum dolor sit amet consectetur.", None), (6, "x" * 200_000 + "\n\nLorem ipsum dolor sit amet consectetur.", None), (7, "Please enable 　 scripts to view this page. And more: see [1].", "web"), (None, "Access denied", "web"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as hash", "'x' as message", "2 as docs")
    assert rows(residue(df), "doc_id") == [(1,), (2,), (6,), (7,), (None,)]
    assert rows(residue(df.where("false")), "doc_id") == []


@pytest.mark.parametrize("half", [False, True])
def test_messages_and_sentences_from_elsewhere(half):
    found = [x for x in probe.MESSAGES if probe.held(x) == half and classify(x)]
    wrong = [x for x in probe.SENTENCES if probe.held(x) == half and classify(x)]
    assert len(found) >= 0.9 * sum(probe.held(x) == half for x in probe.MESSAGES)
    assert len(found) >= 0.9 * (len(found) + len(wrong))


def test_in_place_of_content(spark, rows):
    around = "The run gave nine cells. {} The reads were corrected. Coverage was even."
    notice = "JavaScript must be switched on for this page."
    docs = [(1, around.format(notice), "a"), (2, notice + " The reads were corrected.", "a"), (3, "Notes\n\n" + notice, "b"), (4, around.format("Sample: {{name}}."), "b"), (5, around.format("Text goes here."), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows(residue(df)) == [(2, ["notice"]), (3, ["notice"]), (4, ["placeholder"]), (5, ["filler"])]


def test_names_in_brackets_count_where_the_frame_recurs(spark, rows):
    docs = [(i, f"Report on [{w}] from the core.", "ab"[i % 2]) for i, w in enumerate(["species", "operator", "flowcell", "species"])] + [(9, "Samples went to [Sanger] in May.", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert rows(residue(df), "doc_id") == [(0,), (1,), (2,), (3,)]
