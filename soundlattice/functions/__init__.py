"""Part of soundlattice; see README."""
