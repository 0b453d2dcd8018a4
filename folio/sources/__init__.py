"""Sources: file trees, repositories, commands, evaluation files; and the dispatch of files to chunkers."""
