"""pagemill: turns tables of raw web pages into clean text, links, images and site documents on Spark."""
