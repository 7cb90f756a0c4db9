from geolith.llm import warc


def test_missing_end_tags_keep_the_page():
    assert warc.text_of("<head><title>a</title><body><p>hello world</p>") == "hello world"
    assert warc.text_of("<head><meta charset=utf-8><title>a</title><p>hello <b>world</b>") == "hello world"
    assert warc.text_of("<head><title>a<body><p>hello</p>").endswith("hello")
    assert warc.text_of('<body><svg class="i"/><p>hello world</p>') == "hello world"
    assert warc.text_of("<p>a</p><template><p>b</p>") == "a\nb"
    assert warc.text_of("<p>a</p><noscript>b") == "a\nb" or warc.text_of("<p>a</p><noscript>b") == "a\n b"


def test_whole_elements_and_open_scripts_go():
    page = "<head><script>x</script><title>t</title><style>y</style></head><p>a</p>"
    assert warc.text_of(page + "<svg><path/>s</svg><template>u</template><noscript>n</noscript><p>b</p>") == "a\n\nb".replace("\n\n", "\n")
    assert warc.text_of("<p>a</p><script>x y") == "a" and warc.text_of("<p>a</p><!-- x y") == "a"
    assert warc.text_of("<head><script>x y") == ""
