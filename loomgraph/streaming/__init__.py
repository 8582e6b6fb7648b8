"""Changes as a stream: an extension for snapshots that follow one another."""
