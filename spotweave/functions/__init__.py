"""spotweave.functions"""
