"""The stateful decoding kernel: plain Python and numpy, no Spark. One instance decodes one stream in order."""
