"""English words, the commonest first: ranked by the number of files, of 13,821 of free software's documentation and libraries, that hold them.

A word is a run of lower-case letters. The list is data, in ranked_words.txt, read as a resource of the package so that it comes with it wherever it runs.
"""

import pkgutil

WORDS = pkgutil.get_data(__package__, "ranked_words.txt").decode("ascii").split()
