"""From text to DataFrames: lexer, parser, syntax trees, translator."""
