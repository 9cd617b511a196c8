"""The deep-scan command with backends named on the command line."""

import os

from findery import cli
from findery.operators.extract import Recognized


class Reader:
    def __init__(self, root):
        self.root = root

    def text_layer(self, path, max_pages):
        with open(f"{self.root}/{path}") as f:
            return f.read()

    def images(self, path, ext, config):
        return None


class Ocr:
    def recognize(self, images):
        return Recognized("", 0.0)


def test_deep_scan_command(spark, tmp_path, capsys):
    base = ["--index-dir", f"{tmp_path}/i", "--log-dir", f"{tmp_path}/l"]
    scan = [*base, "deep-scan", "--reader", "test_deep_scan_command:Reader", "--ocr", "test_deep_scan_command:Ocr"]
    assert cli.main(scan) == 1
    os.makedirs(f"{tmp_path}/corpus/Unsorted")
    for name, text in (("old_backup.pdf", "a text layer that is long enough"), ("blank.jpg", "")):
        with open(f"{tmp_path}/corpus/Unsorted/{name}", "w") as f:
            f.write(text)
    assert cli.main([*base, "index", "--corpus-root", f"{tmp_path}/corpus"]) == 0
    capsys.readouterr()
    assert cli.main(scan) == 0 and capsys.readouterr().out == "1 filled, 1 to review\n"
    assert cli.main([*base, "review-queue"]) == 0 and "blank.jpg: unreadable_image" in capsys.readouterr().out
    assert cli.main(scan) == 0 and capsys.readouterr().out == "0 filled, 0 to review\n"
