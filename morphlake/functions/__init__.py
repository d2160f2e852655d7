"""Column builders: lexing, encoding, BIES decoding, tag sets."""
