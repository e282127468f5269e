"""A server of the pull protocol: python pull_server.py LINES-FILE BATCH.  Prints its port; closes after the last line if told to."""

import socket
import sys

lines = open(sys.argv[1]).read().splitlines()
sizes = [int(x) for x in sys.argv[2].split(",")]
server = socket.create_server(("127.0.0.1", 0))
print(server.getsockname()[1], flush=True)
at = 0
while True:
    link, _ = server.accept()
    stream = link.makefile("rw", encoding="utf-8", newline="\n")
    while stream.readline() == "data\n":
        n = sizes.pop(0) if sizes else 0
        if n < 0:
            sys.exit()
        part = lines[at : at + n]
        at += len(part)
        stream.write(f"{len(part)}\n" + "".join(x + "\n" for x in part))
        stream.flush()
