"""spotweave.sources"""
